"""URL filtering by association rules that Spark's FP-growth mines from labelled urls.

A url becomes a set of at most ten tokens, one for each place of a fixed scheme (host suffixes, first labels, folders,
ending, query keys, fragment), so a set has a bounded number of subsets however long the url is. FP-growth counts the
combinations of tokens and verdict among the labelled urls; a combination is kept as a rule when it is frequent enough
(support) and its urls mostly have that verdict (confidence), and dropped when a part of it is a rule for the same verdict
with at least its confidence. The rules form an inverted index: each is filed under its rarest token, so that a url looks
at the rules of its own tokens only and takes the strongest whose tokens it has.

Fixed rules of a host and a path come first; of those that fit a url the longest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import ascii_lower, written

BLOCK, ALLOW = "block", "allow"
#: Verdict, host and path of the fixed rules.
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
#: The verdict as a token of a labelled url; other tokens have no space.
VERDICT = "verdict "


@dataclass(frozen=True)
class Mining:
    """least_support: share of the labelled urls that a rule covers with its verdict, at least. Each url has at most
    2**11 combinations, so there are no more than 2**11 / least_support rules: that bounds the index which is broadcast.
    least_urls: the same as a number. least_confidence: share of the urls with a rule's tokens that have its verdict.
    default: for urls that no rule fits."""

    least_support: float = 0.002
    least_urls: int = 5
    least_confidence: float = 0.6
    default: str = ALLOW


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: then up to ``?``, ``#``
    or the end. Both are empty for a null and for a url without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, which are longer, go first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The url's tokens, sorted and distinct; empty for a null and for a url without ``://``."""
    host, path = host_and_path(url)
    labels, folders = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    n, last = F.size(labels), F.element_at(F.split(path, "/"), -1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.regexp_extract(x, "^[^=]*", 0))))
    found = F.array(
        F.concat(F.lit("top="), F.element_at(labels, -1)),
        F.when(n >= 2, F.concat(F.lit("site="), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."))),
        F.when(n >= 3, F.concat(F.lit("owner="), F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), 3), "."))),
        F.when(n >= 3, F.concat(F.lit("first="), F.element_at(labels, 1))),
        F.when(F.size(folders) >= 1, F.concat(F.lit("folder="), F.get(folders, F.lit(0)))),
        F.when(F.size(folders) >= 2, F.concat(F.lit("second="), F.regexp_replace(F.get(folders, F.lit(1)), "[0-9]+", "0"))),
        F.when(last.contains("."), F.concat(F.lit("ending="), F.regexp_extract(last, r"([^.]*)$", 1))),
        F.when(F.size(keys) > 0, F.concat(F.lit("key="), F.get(keys, F.lit(0)))),
        F.when(F.size(keys) > 1, F.concat(F.lit("keys="), F.array_join(keys, "+"))),
        F.when(url.contains("#"), F.lit("fragment")),
    )
    found = F.array_sort(F.array_distinct(F.transform(F.array_compact(found), lambda x: F.translate(x, " ", "+"))))
    return F.when(host != "", found).otherwise(F.array().cast("array<string>"))


def mined_rules(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:  # noqa: B008
    """Rules from ``labelled(url, verdict)``: ``tokens, verdict, support`` (urls), ``confidence``.

    Urls without a host and rows whose verdict is neither block nor allow teach nothing. Each row counts, repeated urls too.
    An empty table gives no rules.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col("verdict").isin(BLOCK, ALLOW)).select(tokens(F.col("url")).alias("tokens"), "verdict")
    baskets = written(known.where(F.size("tokens") > 0).select(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items")), "baskets")
    total = baskets.count()
    if not total:
        return spark.createDataFrame([], "tokens array<string>, verdict string, support bigint, confidence double")
    least = max(mining.least_support, mining.least_urls / total)
    if least > 1:
        return mined_rules(labelled.limit(0), mining)
    sets = FPGrowth(itemsCol="items", minSupport=least, minConfidence=1.0).fit(baskets).freqItemsets
    sets = sets.select(F.filter("items", lambda x: ~x.startswith(VERDICT)).alias("t"), F.get(F.filter("items", lambda x: x.startswith(VERDICT)), F.lit(0)).alias("v"), F.col("freq"))
    sets = written(sets.select(F.array_sort("t").alias("tokens"), "v", "freq"), "token-sets")
    whole = sets.where(F.col("v").isNull()).select("tokens", F.col("freq").alias("all"))
    rules = sets.where(F.col("v").isNotNull() & (F.size("tokens") > 0)).join(whole, "tokens")
    rules = rules.select("tokens", F.substring("v", len(VERDICT) + 1, 99).alias("verdict"), F.col("freq").alias("support"), (F.col("freq") / F.col("all")).alias("confidence"))
    return _shortest(written(rules, "rules"), mining.least_confidence)


def _shortest(rules: DataFrame, least: float) -> DataFrame:
    """Rules with a confidence of ``least``, without those of which a part has the same verdict with no less confidence.

    Every part of a frequent set is frequent, so the best confidence among a set's parts comes from those one shorter,
    and theirs from those before them: one step for each size of a set, ten at most.
    """
    longest = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    best = rules.where(F.size("tokens") == 1).withColumn("before", F.lit(-1.0))
    done = best
    for size in range(2, longest + 1):
        now = rules.where(F.size("tokens") == size)
        parts = now.select("tokens", "verdict", F.explode(F.transform("tokens", lambda x: F.array_except(F.col("tokens"), F.array(x)))).alias("part"))
        known = best.select(F.col("tokens").alias("part"), "verdict", F.greatest("confidence", "before").alias("held"))
        most = parts.join(known, ["part", "verdict"], "left").groupBy("tokens", "verdict").agg(F.coalesce(F.max("held"), F.lit(-1.0)).alias("before"))
        best = written(now.join(most, ["tokens", "verdict"]), "rules")
        done = done.unionByName(best)
    return done.where((F.col("confidence") >= least) & (F.col("before") < F.col("confidence"))).select("tokens", "verdict", "support", "confidence")


def judge(urls: DataFrame, rules: DataFrame, mining: Mining = Mining()) -> DataFrame:  # noqa: B008
    """``urls`` with a mined verdict and its rule: ``mined_verdict``, ``mined_rule`` (tokens, null if none fits).

    urls: needs a column ``_tokens``. Of the rules whose tokens a url has, the one with the highest confidence decides, then
    support, number of tokens, tokens and verdict. Rules are broadcast; ``Mining`` says why they are few.
    """
    shared = urls.sparkSession.sparkContext.broadcast(_index(rules.collect()))
    schema = StructType([*urls.schema.fields, StructField("mined_verdict", StringType()), StructField("mined_rule", StringType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value, {}
        for batch in batches:
            verdicts, names = [], []
            for have in batch["_tokens"].to_pylist():
                key = tuple(have)
                if key not in known:
                    if len(known) > 100_000:  # a memo, not a limit
                        known.clear()
                    has = set(key)
                    fitting = (r for t in key for r in index.get(t, ()) if r[1] <= has)
                    strongest = min(fitting, key=lambda r: r[0], default=None)
                    known[key] = (strongest[2], " ".join(sorted(strongest[1]))) if strongest else (mining.default, None)
                verdicts.append(known[key][0])
                names.append(known[key][1])
            columns = [*batch.columns, pa.array(verdicts, pa.string()), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "mined_verdict", "mined_rule"])

    return urls.mapInArrow(look_up, schema)


def _index(rules: list) -> dict[str, list[tuple]]:
    """Rules by the token that the fewest rules have; each with its rank, tokens and verdict."""
    often: dict[str, int] = {}
    for r in rules:
        for t in r.tokens:
            often[t] = often.get(t, 0) + 1
    out: dict[str, list[tuple]] = {}
    for r in rules:
        rank = (-r.confidence, -r.support, len(r.tokens), sorted(r.tokens), r.verdict)
        out.setdefault(min(r.tokens, key=lambda t: (often[t], t)), []).append((rank, frozenset(r.tokens), r.verdict))
    return out


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, verdict`` of the pages whose id has a label: block where any of its rows says quality 0 or toxic 1, allow where
    others say something. Null ids and labels are left out."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where(F.coalesce("quality", "toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    known = known.agg(F.max(F.coalesce(bad, F.lit(False))).alias("_bad"))
    joined = pages.select("page_id", "url").join(known, F.col("page_id") == F.col("_id"))
    return joined.select("url", F.when(F.col("_bad"), BLOCK).otherwise(ALLOW).alias("verdict"))


def judge_pages(pages: DataFrame, labels: DataFrame, mining: Mining = Mining(), rules=RULES) -> DataFrame:  # noqa: B008
    """``page_id, host, path, rule, verdict, mined_rule`` for each row of ``pages``.

    A null url and one without ``://`` have an empty host and path; they fit no rule and get the default. Rows that repeat
    are judged one by one; other columns of ``pages`` are not looked at, whatever their names. An empty table gives none.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), tokens(F.col("url")).alias("_tokens"))
    out = judge(rows, mined_rules(labelled_urls(pages, labels), mining), mining)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, "mined_verdict").alias("verdict"), F.when(name.isNull(), F.col("mined_rule")).alias("mined_rule"))
