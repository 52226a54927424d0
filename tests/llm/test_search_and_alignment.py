"""Hard negatives, token alignment and url rules against plain versions, with odd, empty, tied and repeated rows."""

import bisect
import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.llm import alignment, negatives, queries, url_rules
from tidemill.llm.common import table

SF = "/root/testdata/sf0.001"

# ---- hard negatives ----

VECTORS = "vec_id bigint, label int, embedding array<float>, units int, _row string"


def slow_negatives(rows, positives=5, negatives=10):
    usable = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for n, (a, label, x) in enumerate(usable):
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, lab) for m, (i, lab, y) in enumerate(usable) if m != n]
        best = sorted((s, i) for s, i, lab in scored if lab == label)[:positives]
        for s, p in best:
            found = sorted((t, i) for t, i, lab in scored if lab != label and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(found)]
    return sorted(out)


def mined(spark, rows):
    made = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    return sorted(map(tuple, negatives.mine(made.repartition(3)).collect()))


def test_negatives_on_odd_rows(spark):
    rnd = random.Random(3)
    vector = lambda n=6: [rnd.uniform(-1, 1) for _ in range(n)]
    rows = [(i, rnd.randrange(3), vector()) for i in range(120)]
    hot = vector()
    rows += [(200 + i, i % 2, hot) for i in range(60)]  # copies: ties everywhere
    rows += [(300, 1, [0.0] * 6), (301, 1, [0.0] * 6), (400, 0, None), (401, None, vector()), (402, 0, [0.1, None, 0.2]), (403, 0, [float("nan")] * 6), (404, 0, [float("inf")] * 6)]
    rows += [(None, 0, vector()), (500, 2, []), (501, 2, vector(3)), (700, 9, [-c for c in hot]), (701, 0, [-c for c in hot])]
    rows += [(600, 1, rows[0][2]), (602, 1, rows[0][2]), (602, 1, rows[0][2])]
    got = mined(spark, rows)
    assert got == slow_negatives(rows) and len(got) > 100


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []  # no anchors
    assert mined(spark, [(100, 0, [1.0])]) == [] and mined(spark, [(100, 0, [1.0]), (101, 0, [-1.0]), (102, 1, [0.5])]) == []
    assert mined(spark, [(100, 0, [1.0]), (101, 0, [1.0]), (102, 1, [0.5])]) == [(100, 101, 1, 102, 65536, 32768)]
    with pytest.raises(ValueError, match="too long"):
        mined(spark, [(100, 0, [1e30]), (101, 0, [1.0])])


@pytest.mark.parametrize("seed", range(6))
def test_threshold_join_finds_all_pairs(seed):
    rnd = np.random.default_rng(seed)
    scale = rnd.uniform(0.1, 60, 12)
    rows, anchors = np.floor(rnd.normal(0, 1, (90, 12)) * scale), np.floor(rnd.normal(0, 1, (7, 12)) * scale)
    bars = np.floor(rnd.choice([-500, 1, 2000, 6000, 20000, np.inf], 7)) if seed else np.full(7, 6000.0)
    a, r, score = negatives.Index(rows, anchors, bars).pairs(bars)
    whole = anchors @ rows.T
    assert {(i, j): s for i, j, s in zip(a, r, score)} == {(i, j): whole[i, j] for i, j in zip(*np.nonzero(whole >= bars[:, None]))}
    if not seed:
        assert (negatives.Index(rows, anchors, bars).left_out > 0).any()  # some dimensions stay out of the index


@pytest.mark.parametrize("seed", range(4))
def test_windows_fill_over_blocks(seed):
    rnd = np.random.default_rng(seed)
    rows, anchors = np.floor(rnd.normal(0, 50, (200, 8))), np.floor(rnd.normal(0, 50, (5, 8)))
    rows[50:90] = rows[3]
    owner, low, high = np.array([0, 0, 1, 3, 4]), np.array([-np.inf, 100, -2000, 5000, 1e9]), np.array([np.inf, 9000, 3000, 7000, 2e9])
    best = negatives.Best(owner, low, high, 4, 5)
    for begin in range(0, 200, 33):
        part = np.arange(begin, min(200, begin + 33))
        negatives.search(best, anchors, rows[part], part, lambda a, r, part=part: part[r] % 3 > 0)
    got = sorted(zip(best.window, best.score, best.id))
    want = []
    for w, o in enumerate(owner):
        s = rows @ anchors[o]
        fits = sorted((-s[i], i) for i in range(200) if i % 3 and low[w] <= s[i] <= high[w])[:4]
        want += [(w, -x, i) for x, i in fits]
    assert got == sorted(want)


# ---- token alignment ----


def slow_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_tokenizers()
    one = Tokenizer.from_file(a_path)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=b_path)
    of = alignment.byte_alphabet()
    a_bytes = lambda i: bytes(of[c] for c in one.id_to_token(i))
    b_bytes = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = one.encode(" " + text, add_special_tokens=False).ids if text else [], two.encode(text) if text else []
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            docs.append(([], [], [], ""))
            continue
        ends = [list(itertools.accumulate(len(f(i)) for i in ids)) for ids, f in ((a, a_bytes), (b, b_bytes))]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links = [], []
        cuts = [[0, *(bisect.bisect_right(es, end) for end in both)] for es in ends]
        for n in range(len(both)):
            parts = [ids[c[n] : c[n + 1]] for ids, c in zip((a, b), cuts)]
            groups.append("|".join(",".join(map(str, p)) for p in parts))
            links.append((parts[0][-1], parts[1][-1]))
        counts.update(links)
        docs.append((a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(len(a), len(b), len(k), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k), h) for a, b, k, h in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query_against_plain_version(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in queries.op12_token_alignment(spark, SF).collect())
    assert got == sorted((d.doc_id, *x) for d, x in zip(docs, slow_alignment([d.text for d in docs])))


ODD = [
    None, "", " ", "  two  spaces ", "\t\n", "a\u0000b", "<|endoftext|> and <s> </s> <0x41>", "lower ▁ eighth", "Ünï cödé ñ 漢字かな 🙂🙂", "e\u0301 é ﬁ Å", "a" * 3000, "x" * 9_000 + " tail",
    " ".join(f"w{i % 700}" for i in range(60_000)), "don't  stop\r\nnow", "\u00a0\u3000 wide", "same text", "same text",
]


def test_alignment_of_odd_texts(spark):
    docs = spark.createDataFrame([(None if n == 3 else n // 2, t, 5, "x") for n, t in enumerate(ODD)], "doc_id bigint, text string, n_a int, pairs string")
    got = [tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(docs.repartition(3)).collect()]
    assert sorted(got) == sorted(slow_alignment(ODD))
    assert alignment.align_documents(docs.limit(0)).count() == 0
    only = alignment.align_documents(docs.where("text is null or text = ''")).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in only] == [(0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("shards", [1, 5])
def test_perfect_hash(shards):
    keys = np.unique(np.random.default_rng(shards).integers(0, 1 << 32, 30_000, dtype=np.uint64)).astype(np.uint32)
    part = alignment.shard_of(keys, shards)
    built = [alignment.build_shard(keys[part == s]) for s in range(shards)]
    assert all(len(b[0]) < 0.6 * len(b[2]) for b in built)  # bytes a key
    held = alignment.PerfectHash(list(range(shards)), shards, *map(list, zip(*built)))
    at = held.numbers(keys)
    assert sorted(at) == list(range(len(keys))) and (held.keys[at] == keys).all()
    with pytest.raises(KeyError):
        held.numbers(np.array([k for k in range(50) if k not in set(keys.tolist())], np.uint32))
    if shards > 1:
        some = alignment.PerfectHash([1, 3], shards, *map(list, zip(built[1], built[3])))
        at = some.numbers(keys)
        assert ((at >= 0) == np.isin(part, [1, 3])).all() and sorted(at[at >= 0]) == list(range(len(some)))


def test_hash_with_keys_beyond_the_last_level(monkeypatch):
    monkeypatch.setattr(alignment, "LEVELS", 2)
    keys = np.arange(5000, dtype=np.uint32)
    part = alignment.shard_of(keys, 3)
    built = [alignment.build_shard(keys[part == s]) for s in range(3)]
    held = alignment.PerfectHash([0, 1, 2], 3, *map(list, zip(*built)))
    assert held.rest and sorted(held.numbers(keys)) == list(range(5000))


@pytest.mark.parametrize("least", [1, 1 << 16])
def test_alignment_in_several_passes(spark, monkeypatch, least):
    """Groups of shards that are looked up in passes of their own give the same sums."""
    monkeypatch.setattr(alignment, "SHARD_PAIRS", 300)
    monkeypatch.setattr(alignment, "GROUP_PAIRS", 300 * least)
    texts = [" ".join(f"word{i * j % 97} lot" for i in range(60)) for j in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(docs).collect()}
    assert got == dict(enumerate(slow_alignment(texts)))


def test_other_vocabularies_raise(tmp_path):
    (tmp_path / "t.json").write_text('{"model": {"vocab": {"a": 0, "b": 1, "ab": 300}, "merges": ["a b"]}, "added_tokens": []}')
    with pytest.raises(ValueError, match="order of merges"):
        alignment.ByteLevel(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="two bytes"):
        alignment.Table([b"x"] * 70_000)


def test_digest_table_and_bytes():
    assert alignment.data_of(pa.array([b"ab", b"", b"c"], pa.large_binary()).slice(1)).tobytes() == b"c"


# ---- url rules ----

URLS = [
    "http://www.bad.example.io/x/1?a=1&b=2#f", "https://bad.example.io", "http://Good.Example.NET/en/", "http://a.net", "http://net/", "http://xnet/", "ftp://q.example.com/de/x", "http://example.com/deep", "http://r.org/fr/",
    "http://r.org/fr", "no scheme", "", None, "http://", "http:///p", "://h/p?q", "a://b://c/d", "http://h?x/y", "http://h#x/y", "http://user@H:80/p;v", "http://ünï.example.net/en/ü?=&&", "http://x.net/en/", "http://example.net/en/x y",
]


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = rest[: min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def slow_mined(labelled, least, confidence):
    """All combinations of tokens, counted one by one."""
    seen, both = Counter(), Counter()
    for t, v in labelled:
        for n in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), n):
                seen[c] += 1
                both[c, v] += 1
    sure = {k: n / seen[k[0]] for k, n in both.items() if n >= least and n / seen[k[0]] >= confidence}
    keep = {}
    for (c, v), s in sure.items():
        parts = (p for n in range(1, len(c)) for p in itertools.combinations(c, n))
        if not any(sure.get((p, v), -1) >= s for p in parts):
            keep[c, v] = (both[c, v], s)
    return keep


def slow_verdict(have, rules, default="allow"):
    fits = [(-s, -n, len(c), sorted(c), v) for (c, v), (n, s) in rules.items() if set(c) <= set(have)]
    return min(fits)[4] if fits else default


def check_pages(spark, pages, labels, mining):
    got = {r.page_id: r for r in url_rules.judge_pages(pages, labels, mining).collect()}
    rows = pages.select("page_id", "url", url_rules.tokens(pages.url).alias("t")).collect()
    marks = {}
    for r in labels.collect():
        if r.quality is not None or r.toxic is not None:
            marks[r.doc_id] = marks.get(r.doc_id, False) or r.quality == 0 or r.toxic == 1
    known = [(r.t, "block" if marks[r.page_id] else "allow") for r in rows if r.page_id in marks and r.t]
    least = math.ceil(max(mining.least_support, mining.least_urls / max(1, len(known))) * len(known) - 1e-9)
    rules = slow_mined(known, least, mining.least_confidence)
    mined = {(tuple(r.tokens), r.verdict): (r.support, r.confidence) for r in url_rules.mined_rules(url_rules.labelled_urls(pages, labels), mining).collect()}
    assert mined == rules
    for r in rows:
        host, path = slow_parts(r.url)
        name, verdict = slow_rule(host, path)
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, name), r.url
        assert got[r.page_id].verdict == (verdict or slow_verdict(r.t, rules)), r.url
    assert len(got) == len(rows)
    return got, rules


def test_url_query_against_all_combinations(spark):
    pages, labels = table(spark, SF, "pages"), table(spark, SF, "labels")
    got, _ = check_pages(spark, pages.select("page_id", "url"), labels, url_rules.Mining())
    asked = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op13_url_filter(spark, SF).collect()}
    assert asked == {i: (r.host, r.path, r.rule, r.verdict) for i, r in got.items()}


def test_url_rules_on_planted_hosts(spark):
    """Hosts whose labels are bad are learnt, and so is a bad combination of tokens that are harmless alone."""
    rnd, rows, marks = random.Random(5), [], []
    for i in range(300):
        site, folder = rnd.choice(["pills", "news", "blog"]), rnd.choice(["win", "home"])
        rows.append((i, f"http://{site}.example.org/{folder}/{i}" + ("?ref=x" if i % 3 else "")))
        if i % 4:
            bad = site == "pills" or (site == "blog" and folder == "win")
            marks += [(i, int(not bad), None), (i, None, 0)] if i % 5 else [(i, None, int(bad))]
    rows += [(1000 + n, u) for n, u in enumerate(URLS)]
    marks += [(None, 0, 1), (1000, 0, 0), (1001, None, None), (1012, 1, 0), (5000, 1, 1)]
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in rows], "page_id bigint, url string, host string, _tokens string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got, rules = check_pages(spark, pages, labels, url_rules.Mining(least_urls=4))
    for i, u in rows[:300]:
        if got[i].rule is None:
            assert got[i].verdict == ("block" if "pills" in u or ("blog" in u and "/win/" in u) else "allow"), u
    assert any(v == "block" and len(c) > 1 for c, v in rules)
    none = url_rules.judge_pages(pages, labels.limit(0)).collect()
    assert {r.verdict for r in none if r.rule is None} == {"allow"} and url_rules.judge_pages(pages.limit(0), labels).count() == 0
    again = url_rules.judge_pages(pages.unionByName(pages), labels)
    assert again.count() == 2 * len(rows)


def test_tokens_are_few_however_long_a_url_is(spark):
    long = "http://" + ".".join("abcdefgh" * 5) + "/" + "/".join(map(str, range(3000))) + "?" + "&".join(f"k{i}=1" for i in range(3000)) + "#x"
    rows = spark.createDataFrame([(long,), (None,), ("http://h",)], "url string").select(url_rules.tokens(F.col("url")).alias("t")).collect()
    assert len(rows[0].t) <= 10 and rows[1].t == [] and rows[2].t == ["top=h"]
