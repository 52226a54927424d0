"""Settings of a run from a YAML or JSON file, with overrides and the checks that a run relies on."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

#: What a configuration must have.
REQUIRED = ("data_dir", "tick_window", "coarse_to_fine", "cost_model", "model_save_dir", "progress_display")
WINDOW = ("start", "end", "step")


def parse(text: str) -> dict[str, Any]:
    """JSON, or YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def merged(base: dict[str, Any], overrides: dict[str, Any] | None) -> dict[str, Any]:
    """Overrides without a value are left out; those of a section replace its entries one by one."""
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    return base | {k: base[k] | v if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in given.items()}


def load(path: str | Path, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    settings = merged(parse(Path(path).read_text(encoding="utf-8")), overrides)
    missing = [k for k in REQUIRED if k not in settings] or [f"tick_window.{k}" for k in WINDOW if k not in settings["tick_window"]]
    if missing:
        raise ValueError(f"missing in {path}: {', '.join(missing)}")
    return settings
