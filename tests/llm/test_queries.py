"""The registered queries on the smallest tables: SQL where there is some, brute force or accuracy where not, and the pipeline."""

import glob
import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_corpus import KINDS, grams, slow_accepts, slow_print, slow_secrets

from tidemill.llm import chat, decontaminate, exact_dedup, license_texts, licenses, lm, mixing, queries, secrets, simhash, toxicity
from tidemill.llm.common import held_out, table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(f):
        return sorted(tuple("" if x is None or x != x else str(round(float(x), 6)) if isinstance(x, (int, float)) else str(x) for x in r) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None))

    assert rows(got) == rows(want)


def test_secrets_and_licenses_against_expressions(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rules = {"assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)"}
    least = {"assign": 8, "access": 16, "hex": 32}
    for r in queries.op6_secret_scan(spark, SF).collect():
        found = sorted((m.start(), n, m.end(), k) for n, (k, x) in enumerate(rules.items()) for m in re.finditer(x, docs[r.doc_id]) if len(m.group(1)) >= least[k])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()).hexdigest()
        assert r.n_hex == sum(k == "hex" for *_, k in found)
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for r in queries.op10_license_scan(spark, SF).collect():
        text = re.sub("[A-Z]", lambda m: m.group().lower(), docs[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at = [(i, v) for k, v in phrases.items() for i in range(len(words)) if words[i : i + len(k.split())] == k.split()]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in at})))


def test_all_spans_and_labels_against_plain_versions(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    kinds = list(KINDS)
    for r in queries.op6_secret_scan(spark, SF).collect():
        assert r.spans == ",".join(f"{kinds[n]}:{a}:{b}" for a, n, b in slow_secrets(docs[r.doc_id]))
    templates = {k: licenses.places_of(v) for k, v in license_texts.TEMPLATES.items()}
    heads = {k: set(licenses.compile_templates({"t": v}).steps[0]) for k, v in license_texts.TEMPLATES.items()}
    for r in queries.op10_license_scan(spark, SF).collect():
        words = licenses.words_of(docs[r.doc_id])
        found = {k for k, places in templates.items() if any(w in heads[k] and slow_accepts(places, words, at) for at, w in enumerate(words))}
        assert r.labels == ",".join(sorted(found | set(filter(None, r.base_labels.split(",")))))
        assert (r.score == 1.0) == bool(found) and 0 <= r.score <= 1 and (r.n_base == 0 or r.score >= 0.5)


def slow_components(prints):
    """The smallest id that each id reaches over fingerprints within three bits."""
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_simhash_query_against_all_pairs(spark):
    prints = {r.doc_id: slow_print(r.text) for r in table(spark, SF, "documents").collect()}
    want = slow_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == {i: (f"{x:016x}", want[i]) for i, x in prints.items()} and len(set(want.values())) < len(want)


def test_toxicity_on_held_out_labels(spark):
    """Some labels are noise: toxic documents without any of the words that the others share."""
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.01")
    rows = got.where("held_out").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) / len(toxic) >= 0.7 and sum(clean) / len(clean) <= 0.03


INSULTS = ["zorgwump", "grizzlefax"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with planted toxic documents, exact and near copies, test passages, odd rows and columns of clashing names."""
    rnd, path = random.Random(11), tmp_path_factory.mktemp("planted")
    plain = ["".join(rnd.choices("abcdeimnorst", k=rnd.randint(2, 7))) for _ in range(400)]
    say = lambda n: rnd.choices(plain, k=n)
    items = [(i, " ".join(say(rnd.randint(8, 30)))) for i in range(6)]
    rows, marks = [], []
    for i in range(420):
        words, bad = say(rnd.randint(40, 160)), i % 6 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(INSULTS)
        if i % 25 == 1:
            words[20:20] = items[i % 6][1].split()
        rows.append((i, " ".join(words)))
        if i < 300:
            marks.append((i, 1, int(bad)))
    base = [t for i, t in rows if i % 6 and i % 25 != 1]
    rows += [(500 + i, base[i].replace(" ", " \n ")) for i in range(20)] + [(550 + i, " ".join(base[i].split() * 6) + " tail") for i in range(20, 30)]
    rows += [(600 + i, " ".join(base[i].split() * 6)) for i in range(20, 30)] + [(700, None), (701, ""), (702, " \t"), (703, None), (None, base[40]), (None, "only " + base[41])]
    rows += [(710, base[50]), (710, base[50]), (711, items[0][1].upper()), (712, " ".join(say(30_000)))]
    docs = [(i, t, "en", [None, "a", "a", "b", "c"][n % 5], len(t or ""), "own", n, 0.5, n) for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, keep_id int, toxicity double, _row int").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def same(a, b):
    return sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr)


def test_pipeline_against_plain_versions(spark, planted):
    stages, docs = dict(corpus_pipeline.STAGES), table(spark, planted, "documents")
    items = {r.item_id: grams(r.text) for r in table(spark, planted, "benchmark").collect()}

    def step(name, docs, keeps):
        """The stage keeps whole rows, with their own values in every column, and just those that ``keeps`` names."""
        out = written(stages[name](spark, docs, planted), "step")
        assert out.columns == docs.columns, name
        before, after = docs.collect(), out.collect()
        assert same(after, keeps(before)), name
        assert 0 < len(after) < len(before), name
        return out

    docs = step("toxicity", docs, lambda rows: [r for r in rows if not any(x in (r.text or "") for x in INSULTS)])

    def distinct(rows):
        groups = defaultdict(list)
        for r in rows:
            groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r)
        return [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]

    # of rows that repeat id and text any one may stay: they differ in the row number alone
    pick = lambda rows: [(r.doc_id, r.text, r.kept, r.toxicity) for r in rows]
    before = docs.collect()
    docs = written(stages["exact dedup"](spark, docs, planted), "step")
    assert same(pick(docs.collect()), pick(distinct(before))) and docs.count() < len(before) - 20

    def representatives(rows):
        roots = slow_components({r.doc_id: slow_print(r.text) for r in rows if r.doc_id is not None})
        return [r for r in rows if r.doc_id is None or roots[r.doc_id] == r.doc_id]

    docs = step("simhash near-dedup", docs, representatives)
    holds = lambda t: any(len(grams(t) & g) >= 0.8 * len(g) - 1e-9 for g in items.values())
    docs = step("benchmark decontamination", docs, lambda rows: [r for r in rows if not holds(r.text)])
    rows, last = docs.collect(), stages["source mix"](spark, docs, planted)
    assert last.columns == [*docs.columns, "size", "source_size", "target", "taken", "slots"]
    got = last.collect()
    whole = {r["_row"]: r for r in rows}
    taken = Counter()
    for r in got:
        assert tuple(r[c] for c in docs.columns) == tuple(whole[r["_row"]]) and r.size == len((r.text or "").split())
        assert 0 < r.taken <= 3 * r.size and r.taken == sum(x.words for x in r.slots) and all(0 <= x.first_word < r.size for x in r.slots)
        taken[r.source] += r.taken
    for r in got:
        assert taken[r.source] == int(r.target + 0.5) and r.source_size == sum(len((x.text or "").split()) for x in rows if x.source == r.source)
    assert sum(taken.values()) == pytest.approx(sum(len((r.text or "").split()) for r in rows), abs=5)
    again = corpus_pipeline.run(spark, planted)
    assert again.columns == last.columns and same(again.select("doc_id", "taken").collect(), last.select("doc_id", "taken").collect())


def test_pipeline_of_empty_tables(spark, planted, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, planted, name).limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
    docs = table(spark, planted, "documents")
    assert corpus_pipeline.drop_toxic(spark, docs, f"file://{tmp_path}").count() == docs.count() == corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}").count()


def test_very_long_texts_pass_every_operator(spark):
    """A text of some megabytes, whole."""
    words = 300_000
    text = " ".join(f"w{i % 5000}x{i % 7}" for i in range(words)) + " token=abcdefgh12 Released under the MIT License"
    docs = spark.createDataFrame([(1, text, "a"), (2, "short text", "b")], "doc_id bigint, text string, source string")
    one = lambda df: df.where("doc_id = 1").first()
    assert one(exact_dedup.exact_groups(docs)).kept and one(simhash.near_groups(docs)).fingerprint == f"{simhash.fingerprint(text):016x}"
    assert one(secrets.scan_documents(docs)).spans[0].start == text.index("token=") and one(licenses.scan(docs)).n_words == words + 7
    assert one(lm.score_documents(docs)).n_tokens == words + 7 and one(mixing.mix(docs)[0]).size == words + 6
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert 0 <= one(toxicity.score_documents(docs, labels)).toxicity <= 1
    items = spark.createDataFrame([(9, " ".join(text.split()[299_900:299_950]))], "item_id bigint, text string")
    assert decontaminate.contained_items(docs, items).first().doc_id == 1
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    got = chat.digests(chat.format_conversations(turns)).where("conv_id = 1").first()
    assert got.loss_chars == len(text) and got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_held_out_matches_crc32(spark):
    import zlib

    rows = spark.range(50).withColumn("h", held_out(F.col("id"), 3)).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)
