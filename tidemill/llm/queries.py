"""The queries opN_<name> over the corpus tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, exact_dedup, licenses, lm, mixing, negatives, secrets, simhash, toxicity, url_rules, warc
from .common import held_out, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("text_digest").alias("text_sha256"))


OP1_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return totals.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(cast(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS everything,
         coalesce(sum(3 * source_size) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS free
  FROM s WINDOW b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * free <= weight * (everything - capped) AS is_full FROM c),
l AS (SELECT capped AS lc, free AS lf FROM f WHERE NOT is_full ORDER BY cap / weight, capped LIMIT 1),
t AS (
  SELECT f.source, source_size,
         CASE WHEN is_full THEN cast(cap AS DOUBLE) ELSE cast(weight * (everything - lc) AS DOUBLE) / cast(lf AS DOUBLE) END AS target
  FROM f LEFT JOIN l ON true),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, cast(round(t.target) AS BIGINT) AS quota,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       cast(greatest(0, least(begin + size, quota) - begin) + greatest(0, least(begin + size, quota - source_size) - begin)
            + greatest(0, least(begin + size, quota - 2 * source_size) - begin) AS BIGINT) AS taken
FROM p
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
iw AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s FROM dw),
si AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s FROM iw),
q AS (SELECT item_id, count(*) AS n FROM si WHERE s <> '' GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN si USING (s) WHERE s <> '' GROUP BY doc_id, item_id)
SELECT doc_id, item_id, k AS n_shared, n AS n_item, k / n AS containment FROM m JOIN q USING (item_id) WHERE k >= 0.8 * n - 1e-9
"""

def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select(
        warc.page_number("record").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.page_number("refers").alias("refers_to")
    )


OP4_SQL = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id < max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id < max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) WINDOW g AS (PARTITION BY h)
"""


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = list(secrets.BASE_RULES)
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, base), F.sha2(line(own), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op9_chat_format(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_turns(rows.unionByName(added), ranks_path), ranks_path)


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, n, q, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, q)),
e AS (SELECT *, replace(replace(r, '\', '\\'), '<|', '<\|') AS er, replace(replace(t, '\', '\\'), '<|', '<\|') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       cast(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn NULLS FIRST, r, t)) AS loss_sha256,
       cast(sum(length(er) + length(et) + 26) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("places", lambda x: x["label"].startswith("phrase "))
    named = F.create_map(*[F.lit(y) for p, k in licenses.PHRASES.items() for y in (f"phrase {p}", k)])
    base_labels = F.array_distinct(F.transform(base, lambda x: F.element_at(named, x["label"])))
    own = F.transform(F.filter("places", lambda x: ~x["label"].startswith("phrase ")), lambda x: x["label"])
    join = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    starts = F.transform(base, lambda x: x["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(base_labels).alias("base_labels"), join(F.concat(base_labels, own)).alias("labels"),
        F.greatest("share", F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS u
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, cast(list_dot_product(a.u, b.u) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, cast(row_number() OVER w AS INTEGER) AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER w <= 10
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizers)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_pages(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_simhash, op3_toxicity, op4_warc, op5_lm_score, op6_secret_scan, op7_source_mix, op8_decontaminate, op9_chat_format, op10_license_scan, op11_hard_negatives, op12_token_alignment, op13_url_filter)
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op4_warc": OP4_SQL, "op7_source_mix": OP7_SQL, "op8_decontaminate": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_hard_negatives": OP11_SQL}
