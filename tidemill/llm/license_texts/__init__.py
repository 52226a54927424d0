"""License wording as template markup: ``<<optional>> ... <<end>>`` may be left out, ``<<var N>>`` is up to N words of any kind.

Fixed values: the published texts. Names that end in ``-text`` stand for a license's whole terms, names in ``-notice`` for
the notice by which a work refers to a license. Long terms are in the files beside this module, from their first to their
last clause. Clause numbers are optional throughout.
"""

import re
from pathlib import Path

_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var 8>> BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so
"""
_MIT = _GRANT + """
, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the
next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.
"""
_BSD_CLAUSES = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution.
"""
_BSD_NAMES = """
<<optional>>3.<<end>> Neither the name of <<var 10>> nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY <<var 10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 10>> BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_LATER = "<<optional>>either<<end>> version {0} of the License<<optional>>, or (at your option) any later version<<end>>."
_GNU = """
<<optional>>This <<var 4>> is<<end>> free software<<optional>>:<<end>> you can redistribute it and/or modify it under the
terms of the GNU {0} General Public License as published by the Free Software Foundation<<optional>>,<<end>> {1} {2} is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details.
"""
_CC = """
licensed under <<optional>>the terms of<<end>> <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution {0}
4.0 <<optional>>international<<end>> <<optional>>public<<end>> license
"""


def _gnu(kind: str, version: str) -> str:
    return _GNU.format(kind, _LATER.format(version), "<<optional>>This<<end>> <<var 4>>")


TEMPLATES = {
    "mit-text": _MIT + _WARRANTY,
    "mit-0-text": _GRANT + "." + _WARRANTY,
    "isc-text": """
Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND <<var 6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var 6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "bsd-2-clause-text": _BSD_CLAUSES + _BSD_WARRANTY,
    "bsd-3-clause-text": _BSD_CLAUSES + _BSD_NAMES + _BSD_WARRANTY,
    "zlib-text": """
This software is provided 'as-is', without any express or implied warranty. In no event will <<var 6>> be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<optional>>1.<<end>> The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. <<optional>>2.<<end>> Altered source versions must be plainly marked as such, and must not be misrepresented as
being the original software. <<optional>>3.<<end>> This notice may not be removed or altered from any source distribution.
""",
    "apache-2.0-notice": "licensed under the apache license <<optional>>version<<end>> 2.0",
    "apache-2.0-header-notice": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at <<var 12>> Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.
""",
    "mit-notice": "<<optional>>this <<var 2>> is<<end>> released under <<optional>>the terms of<<end>> the mit license",
    "gpl-2.0-notice": "<<optional>>this <<var 2>> is<<end>> licensed under the <<optional>>gnu<<end>> general public license <<optional>>version<<end>> 2",
    "gpl-3.0-notice": "<<optional>>this <<var 2>> is<<end>> licensed under the <<optional>>gnu<<end>> general public license <<optional>>version<<end>> 3",
    "gpl-2.0-header-notice": _gnu("", "2"), "gpl-3.0-header-notice": _gnu("", "3"),
    "lgpl-2.1-header-notice": _gnu("Lesser", "2.1"), "lgpl-3.0-header-notice": _gnu("Lesser", "3"), "agpl-3.0-header-notice": _gnu("Affero", "3"),
    "mpl-2.0-notice": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at <<optional>>http<<optional>>s<<end>>://mozilla.org/MPL/2.0/<<end>>
""",
    "cc-by-4.0-notice": _CC.format(""), "cc-by-sa-4.0-notice": _CC.format("sharealike"), "cc-by-nc-4.0-notice": "licensed under <<optional>>the<<end>> cc by nc 4.0",
    "cc-by-nc-4.0-name-notice": _CC.format("noncommercial"),
    "bsd-notice": "licensed under <<optional>>the terms of<<end>> <<optional>>the<<end>> <<optional>>new<<end>> <<optional>>3 clause<<end>> <<optional>>2 clause<<end>> bsd license",
    "all-rights-notice": "copyright <<optional>>c<<end>> <<var 6>> all rights reserved",
}


def whole_terms() -> dict[str, str]:
    """The long terms, by name, with their clause numbers and letters optional."""
    out = {}
    for path in sorted(Path(__file__).parent.glob("*.txt")):
        out[f"{path.stem}-text"] = re.sub(r"(?m)^\s*(\d+(?:\.\d+)*\.|\(?[a-z]\))(?=\s)", r" <<optional>>\1<<end>> ", path.read_text(encoding="utf-8"))
    return out


def all_templates() -> dict[str, str]:
    return TEMPLATES | whole_terms()
