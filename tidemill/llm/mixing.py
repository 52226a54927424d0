"""Mixing sources to target weights with a low-discrepancy source schedule (DataFrame operations only).

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating; they share all words by weight, no source
beyond ``most_passes`` times its own words, the excess reshared (water filling in closed form).

Schedule: slot k of the mix takes the golden-ratio point frac(k * phi), mapped through the cumulative weights to a
source. Slots are ranked per source; rank r takes the r-th block of the source's shuffled documents, pass after pass.
Blocks hold ``block_words`` words (the last of a pass may be shorter, and the last of a source is cut at its target).
Three points are laid per block that is needed: gaps between golden-ratio points are at most 1.9 / points long, so
every source meets at least as many slots as it has blocks to give, and its taken words equal its rounded target.

Ranks and prefix sums are made in two levels (chunks or hash buckets, then within one), so no window holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, one_space, written

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 512
#: Slots whose ranks are made together.
CHUNK = 16384
#: Fractional part of the golden ratio as a numerator over 2**40: points are exact integers and the same on every run.
GOLDEN = 679535556991
UNIT = 1 << 40


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return: the spaces of the normal form plus one."""
    plain = F.trim(one_space(text))
    return F.when(plain == "", 0).otherwise(F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """Rows with size, place in their source's shuffle (_bucket, _order) and the source without nulls (_none, _src)."""
    out = docs.withColumn("size", word_count(F.col("text"))).withColumn("_order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    return out.withColumn("_bucket", F.substring("_order", 1, 3)).withColumn("_none", F.col("source").isNull()).withColumn("_src", F.coalesce("source", F.lit("")))


def _running(df: DataFrame, by: list[str], order: list, sums: dict[str, str], few: bool) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of that column over the rows before in the order of ``by`` + ``order``.

    With few rows that is one window; else rows are dealt by ranges of the order, the parts are stored so that they stay
    as they are, and sums over parts come before the sums within one.
    """
    place = [*by, *order]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if few:
        w = before(Window.orderBy(*place))
        return df.withColumns({k: F.coalesce(F.sum(c).over(w), F.lit(0)) for k, c in sums.items()})
    parts = written(df.repartitionByRange(*place).withColumn("_part", F.spark_partition_id()), "mix-parts")
    whole = parts.groupBy("_part").agg(*[F.sum(c).alias("_0" + k) for k, c in sums.items()])
    whole = whole.select("_part", *[F.coalesce(F.sum("_0" + k).over(before(Window.orderBy("_part"))), F.lit(0)).alias("_1" + k) for k in sums])
    w = before(Window.partitionBy("_part").orderBy(*place))
    out = parts.join(F.broadcast(whole), "_part")  # a row for each partition
    out = out.withColumns({k: F.col("_1" + k) + F.coalesce(F.sum(c).over(w), F.lit(0)) for k, c in sums.items()})
    return out.drop("_part", *["_1" + k for k in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """From rows (_none, _src, size): one row per source with source_size, weight, target and quota (target in whole words)."""
    own = written(sizes.groupBy("_none", "_src").agg(F.sum("size").alias("source_size"), F.lit(1).alias("_one")), "mix-sources")
    few, by_name = _few(own), [F.col("_none"), F.col("_src").cast("binary")]
    cycle = F.array(*[F.lit(int(x)) for x in weights])
    own = _running(own, [], by_name, {"_n": "_one"}, few)
    own = own.withColumn("weight", F.element_at(cycle, (F.col("_n") % len(weights) + 1).cast("int")).cast("bigint")).withColumn("cap", F.col("source_size") * most_passes)
    own = own if few else written(own, "mix-weights")
    words, share = own.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    # Sources fill in the order of cap / weight: those before the level have their cap, the others share the rest by weight.
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of many words and many sources pass 64 bits
    own = _running(own, [F.col("cap") / F.col("weight")], by_name, {"capped": "cap", "_before": "weight"}, few)
    own = own.withColumn("open", F.lit(share) - F.col("_before"))
    own = own.withColumn("full", wide(F.col("cap")) * wide(F.col("open")) <= wide(F.col("weight")) * wide(F.lit(words) - F.col("capped")))
    own = own if few else written(own, "mix-filled")
    level = own.where(~F.col("full")).agg(F.min(F.struct((F.col("cap") / F.col("weight")).alias("at"), "capped", "open")).alias("x")).first()["x"]
    target = F.col("cap").cast("double")
    if level:
        target = F.when(F.col("full"), target).otherwise(F.col("weight") * F.lit(words - level["capped"]) / F.lit(level["open"]))
    own = own.withColumn("target", target)
    return own.withColumn("quota", F.round("target").cast("bigint")).select("_none", "_src", "source_size", "weight", "target", "quota")


def needed_blocks(goal: DataFrame, block_words: int) -> DataFrame:
    """Adds pass_blocks (blocks of one pass) and blocks (that begin below the quota over all passes)."""
    a_pass = F.ceil(F.col("source_size") / block_words)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    part = F.ceil((F.col("quota") - whole * F.col("source_size")) / block_words)
    return goal.withColumn("pass_blocks", a_pass).withColumn("blocks", whole * a_pass + part)


def source_slots(goal: DataFrame) -> DataFrame:
    """The schedule: slot, source (_none, _src) and rank of the slot in its source, for ranks that have a block to give."""
    spark, few = goal.sparkSession, _few(goal)
    total = goal.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    steps = _running(goal.where("blocks > 0"), [], [F.col("_none"), F.col("_src").cast("binary")], {"lo": "blocks"}, few).withColumn("hi", F.col("lo") + F.col("blocks"))
    points = spark.range(3 * int(total)).select(
        F.col("id").alias("slot"),
        # frac(slot * phi) as a numerator over 2**40, from the slot's upper and lower 20 bits so that nothing overflows
        F.expr(f"(((shiftright(id, 20) * {GOLDEN % (1 << 20)}L) & 1048575L) * 1048576L + (id & 1048575L) * {GOLDEN}L) & {UNIT - 1}L").alias("part"),
    ).withColumn("point", F.col("part").cast("double") / float(UNIT) * int(total))
    # The cumulative weights as a map from a cell of the block line to the sources that share the cell: an equi-join.
    cell = max(1, int(total) // 4096)
    cells = steps.withColumn("cell", F.explode(F.sequence((F.col("lo") / cell).cast("bigint"), ((F.col("hi") - 1) / cell).cast("bigint"))))
    at = points.withColumn("cell", (F.col("point") / cell).cast("bigint")).join(F.broadcast(cells) if few else cells, "cell").where("point >= lo and point < hi")
    at = at.select("slot", "_none", "_src", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = at.groupBy("_none", "_src", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("_none", "_src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_none", "_src", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("_none", "_src", "chunk").orderBy("slot")
    ranked = at.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["_none", "_src", "chunk"])
    return ranked.withColumn("rank", F.col("rank") + F.col("first")).where("rank < blocks").select("slot", "_none", "_src", "rank")


def places(rows: DataFrame) -> DataFrame:
    """Adds begin, the words of the source's shuffle before the row."""
    sums = rows.groupBy("_none", "_src", "_bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("_none", "_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_none", "_src", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_none", "_src", "_bucket").orderBy("_order", "doc_id", "size")
    out = rows.withColumn("begin", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return out.join(starts, ["_none", "_src", "_bucket"]).withColumn("begin", F.col("begin") + F.col("_first")).drop("_first")


def mix(docs: DataFrame, seed: str = "mix", block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most_passes: int = MOST_PASSES) -> tuple[DataFrame, DataFrame]:
    """(totals, spans). totals: one row per document with size, source_size, target, taken, and in slots what the mix
    reads of it (structs of slot, pass, first_word and words, in training order). spans: the same, a row for each slot.

    Null texts have size 0, a null source is a source of its own, sources and ids may repeat (each row is a document of
    its own), texts may be of any length; an empty table or one without words takes nothing. Only doc_id, source and text
    are read, and _row where there is one: a number of its own for each row, which totals then has too.
    """
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    base = docs.select("doc_id", "source", "text", row.alias("_row"))
    rows = written(sized(base, seed).drop("text"), "mix-sizes")
    goal = written(needed_blocks(targets(rows.select("_none", "_src", "size"), weights, most_passes), block_words), "mix-targets")
    slots = written(source_slots(goal), "mix-slots")
    key = ["_none", "_src"]
    placed = written(places(rows).join(F.broadcast(goal) if _few(goal) else goal, key), "mix-places")
    blocks = (
        placed.where("size > 0")
        .withColumn("pass", F.explode(F.expr(f"sequence(0, {most_passes - 1})")))
        .withColumn("block", F.explode(F.expr(f"sequence(begin div {block_words}, (begin + size - 1) div {block_words})")))
        .withColumn("from_word", F.greatest("begin", F.col("block") * block_words))
        .withColumn("to_word", F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words, F.col("quota") - F.col("pass") * F.col("source_size")))
        .where("to_word > from_word")
        .withColumn("rank", F.col("pass") * F.col("pass_blocks") + F.col("block"))
    )
    spans = blocks.join(slots, [*key, "rank"])
    spans = spans.select("slot", "pass", "doc_id", "_row", (F.col("from_word") - F.col("begin")).alias("first_word"), (F.col("to_word") - F.col("from_word")).alias("words"))
    taken = spans.groupBy("_row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("slot", "pass", "first_word", "words"))).alias("slots"))
    totals = placed.join(taken, "_row", "left").select("_row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "slots")
    return totals, spans.select("slot", "pass", "doc_id", "first_word", "words")


FIGURES = ("size", "source_size", "target", "taken", "slots")


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that the mix reads, with all columns of ``docs`` and the FIGURES of ``mix``; ``settings`` are its own.
    Odd rows are as there; documents of no words are never read. A column of ``docs`` named like a figure is left out."""
    name = free_name(docs, "_row")
    base = written(docs.withColumn(name, F.monotonically_increasing_id()), "mix-documents")
    totals, _ = mix(base.select("doc_id", "source", "text", F.col(name).alias("_row")), **settings)
    found = totals.where("taken > 0").select(F.col("_row").alias(name), *FIGURES)
    own = [c for c in docs.columns if c.lower() not in FIGURES]
    return base.select(name, *[f"`{c}`" for c in own]).join(found, name).drop(name)


def _few(goal: DataFrame, most: int = 100_000) -> bool:
    """Whether the sources are few enough to broadcast (about 100 bytes each)."""
    return goal.select("_src").limit(most + 1).count() <= most
