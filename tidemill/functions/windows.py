"""Window building blocks: rolling frames with minimum counts, exponential means, runs, carries and distributed numbering.

A series (the bars of a symbol and size) may be longer than a task should hold, so its windows run over chunks of bars
(``in_chunks``): each chunk is led by copies of the bars before it, as many as the longest window looks back, and followed
by as many as the longest looks ahead. One shuffle and one sort serve all windows of a chunk.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Bars of a chunk, and bars that lead it where exponential means need them: what is older has less weight than the last
#: digit of a double (a mean of span 100 keeps 1e-35 of it).
CHUNK = 16384
WARM = 4096
#: A mean keeps exp(-FORGOTTEN) of a weight, the last digits of a double, at the far end of its look-back.
FORGOTTEN = 36
#: Bars of a block, within which an exponential mean is a prefix sum of scaled terms.
BLOCK = 512


def series(by: Sequence[str] = ("symbol", "bar_size"), order: str = "bar_no") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def in_chunks(bars: DataFrame, by: Sequence[str], back: int, ahead: int = 0, chunk: int | None = None) -> DataFrame:
    """``bars`` (with bar_no, from 0 without gaps) in chunks with their leading and following bars, dealt by chunk.

    Adds _chunk, _block, _at (place in the block) and _own (not a copy).
    """
    chunk = chunk or CHUNK
    if back > chunk or ahead > chunk:
        raise ValueError("a chunk must be as long as its lead and its tail")
    own, place = F.expr(f"bar_no div {chunk}"), F.col("bar_no") % chunk
    copies = F.array(own, F.when(place >= chunk - back, own + 1), F.when((place < ahead) & (own > 0), own - 1))
    rows = bars.withColumn("_chunk", F.explode(F.array_compact(copies))).withColumns({
        "_own": F.col("_chunk") == own, "_block": F.expr(f"bar_no div {BLOCK}"), "_at": F.col("bar_no") % BLOCK,
    })
    return dealt(rows, by)


def dealt(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows by chunk, to a fixed number of partitions: windows cost far more than bytes say, by which adaptive execution
    would join the small ones to a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_chunk")


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.where("_own").drop("_chunk", "_own", "_block", "_at")


def chunk_window(by: Sequence[str]) -> WindowSpec:
    """A chunk in the order of its bars. Blocks come first in the order so that windows of blocks need no sort of their own."""
    return Window.partitionBy(*by, "_chunk").orderBy("_block", "bar_no")


def frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling(fn, x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """``fn`` over the last ``n`` rows; null until ``least`` (default all n) of them have a value."""
    over = frame(w, n)
    return F.when(F.count(x).over(over) >= (n if least is None else least), fn(x).over(over))


def mean_without_current(x: Column, w: WindowSpec, reach: int) -> Column:
    """Mean of the rows within ``reach`` before and after, the current one left out; null if there is none."""
    over = w.rowsBetween(-reach, reach)
    own = F.coalesce(x, F.lit(0.0))
    return F.try_divide(F.sum(x).over(over) - own, F.count(x).over(over) - F.when(x.isNull(), 0).otherwise(1))


def rolling_list(x: Column, n: int, w: WindowSpec) -> Column:
    return F.collect_list(x).over(frame(w, n))


def rolling_median(x: Column, n: int, w: WindowSpec) -> Column:
    """Median of the values among the last ``n`` rows (missing ones are skipped)."""
    xs = rolling_list(x, n, w)
    size, xs = F.size(xs), F.sort_array(xs)
    mid = (F.element_at(xs, (F.floor((size + 1) / 2)).cast("int")) + F.element_at(xs, (F.floor(size / 2) + 1).cast("int"))) / 2
    return F.when(size > 0, mid)


def rolling_mad(x: Column, n: int, w: WindowSpec) -> Column:
    """Mean absolute deviation from the mean of the last ``n`` values; null until there are ``n``."""
    xs = rolling_list(x, n, w)
    mean = F.avg(x).over(frame(w, n))
    off = sum((F.abs(F.get(xs, F.lit(i)) - mean) for i in range(n)), F.lit(0.0))  # compiled, as functions over arrays are not
    return F.when(F.size(xs) >= n, off / n)


def _carry(ends: str, reach: int, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` (so far, element) along the last ``reach`` elements of an array that may have fewer, from 0."""
    out = F.lit(0.0)
    for i in range(reach, 0, -1):
        out = step(out, F.get(F.col(ends), F.size(ends) - i))
    return out


def ewm_steps(name: str, x: str, by: Sequence[str], *, span: float | None = None, alpha: float | None = None, gaps: bool = False) -> dict[str, tuple[tuple[str, ...], Callable[[], Column]]]:
    """The exponential mean ``name`` of the column ``x`` (recursion from its first value) as columns {name: (needed, make)}.

    It is the first value plus the mean of what the others are off it, so a constant's mean is that constant exactly.
    Within a block the mean is the prefix sum of terms scaled up by their age, scaled down again; the means at the ends of
    the blocks before it are folded into one carry. The first values of x may be missing; with ``gaps`` any may, and while
    one is missing the weight of the old mean decays.
    """
    alpha = alpha if alpha is not None else 2 / (span + 1)
    keep = 1 - alpha
    if keep**BLOCK < 1e-300:
        raise ValueError("the mean forgets too fast for its block; use a wider span")
    w, block = chunk_window(by), Window.partitionBy(*by, "_chunk", "_block").orderBy("bar_no")
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    reach = math.ceil(FORGOTTEN / (-math.log(keep) * BLOCK))
    if reach * BLOCK > WARM:
        raise ValueError(f"the mean remembers more than the {WARM} bars that lead a chunk; use a narrower span or a longer lead")
    reach = WARM // BLOCK if gaps else max(1, reach)
    earlier = Window.partitionBy(*by, "_chunk").orderBy("_block").rangeBetween(-reach, -1)
    at_end, c = F.col("_at") == BLOCK - 1, F.col
    base, part, ends = f"_{x}_base", f"_{name}_part", f"_{name}_ends"
    first = {base: ((x,), lambda: F.first(x, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))}
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    off = zero(c(x) - c(base))
    if gaps:
        seen, held, scale = (f"_{name}_{k}" for k in ("seen", "held", "scale"))
        faded = F.pow(F.lit(keep), c("bar_no") - c(seen))
        return first | {
            seen: ((x,), lambda: F.last(F.when(c(x).isNotNull(), c("bar_no")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))),
            held: ((x, seen), lambda: F.when(c(x).isNull() | c(seen).isNull(), 1.0).otherwise(faded / (faded + alpha))),
            scale: ((held,), lambda: F.sum(F.log(c(held))).over(so_far)),
            part: ((x, base, held, scale), lambda: F.exp(c(scale)) * F.sum((1 - c(held)) * off * F.exp(-c(scale))).over(so_far)),
            ends: ((part, scale), lambda: F.collect_list(F.when(at_end, F.struct(F.exp(c(scale)).alias("d"), c(part).alias("p")))).over(earlier)),
            name: ((base, part, scale, ends), lambda: c(base) + c(part) + F.exp(c(scale)) * _carry(ends, reach, lambda a, e: a * zero(e["d"]) + zero(e["p"]))),
        }
    down = lambda shift=0: F.pow(F.lit(keep), c("_at") + shift)
    mean = lambda: c(base) + c(part) + down(1) * _carry(ends, reach, lambda a, p: a * (keep**BLOCK) + zero(p))
    return first | {
        part: ((x, base), lambda: down() * F.sum(alpha * off * F.pow(F.lit(keep), -c("_at"))).over(so_far)),
        ends: ((part,), lambda: F.collect_list(F.when(at_end, c(part))).over(earlier)),
        name: ((x, base, part, ends), lambda: F.when(c(x).isNotNull(), mean())),
    }


def with_needed(rows: DataFrame, wanted: Sequence[str], recipes: dict[str, tuple[tuple[str, ...], Callable[[], Column]]]) -> DataFrame:
    """``rows`` with the ``wanted`` columns and what they need, level by level; columns that are there are not made again."""
    depth: dict[str, int] = {}
    there = set(rows.columns)

    def level(name: str) -> int:
        if name in there:
            return 0
        if name not in depth:
            depth[name] = 1 + max((level(x) for x in recipes[name][0]), default=0)
        return depth[name]

    for name in wanted:
        level(name)
    for n in sorted(set(depth.values())):
        rows = rows.withColumns({k: recipes[k][1]() for k, v in depth.items() if v == n})
    return rows


def carried(rows: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Chunked ``rows`` with each name's last value so far over the whole series (missing ones are skipped): the last one of
    the chunk, or else of the chunks before."""
    w, marked = chunk_window(by), rows.withColumns({f"_v_{k}": v for k, v in columns.items()})
    last = [F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col("bar_no"))).alias(f"_e_{k}") for k in columns]
    ends = marked.where("_own").groupBy(*by, "_chunk").agg(*last)
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(k).alias("_k_" + k) for k in (*by, "_chunk")], *[F.last(f"_e_{k}", True).over(before).alias(f"_c_{k}") for k in columns])
    on = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in (*by, "_chunk")]
    out = dealt(marked.join(ends, on, "left").drop(*["_k_" + k for k in (*by, "_chunk")]), by)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({k: F.coalesce(F.last(f"_v_{k}", True).over(so_far), f"_c_{k}") for k in columns})
    return out.drop(*[f"_v_{k}" for k in columns], *[f"_c_{k}" for k in columns])


#: Bars after which two runs of a state machine are compared.
COMPARE = 256


def _line(state) -> str:
    """A state as text: equal states have equal lines."""
    return json.dumps(state, sort_keys=True, default=lambda x: x.item())


def _state(line: str | None):
    return None if line is None else json.loads(line)


def run_until_agreed(f: pd.DataFrame, fold: Callable, guess, true, end: str) -> str:
    """The state at the end of the bars ``f`` from the state ``true``, knowing that from ``guess`` it is ``end``: both runs go
    on side by side until they agree, and then they end alike."""
    for s in range(0, len(f), COMPARE):
        part = f.iloc[s : s + COMPARE]
        guess, true = fold(part, guess)[1], fold(part, true)[1]
        if _line(guess) == _line(true):
            return end
    return _line(true)


def side_by_side(folds: dict[str, Callable]) -> Callable:
    """The fold of several state machines over the same bars, whose state has one of each by name."""

    def fold(f: pd.DataFrame, state: dict | None) -> tuple[dict, dict]:
        out, after = {}, {}
        for name, one in folds.items():
            made, after[name] = one(f, (state or {}).get(name))
            out |= made
        return out, after

    return fold


def folded(rows: DataFrame, by: Sequence[str], fold: Callable, outputs: dict[str, str], needs: Sequence[str], chunk: int | None = None) -> DataFrame:
    """``rows`` with the ``outputs`` (name: type) of a state machine that runs along each series.

    ``fold(frame, state)`` reads the columns ``needs`` and gives the arrays of the outputs for consecutive bars and the state
    after them (None before the first; of numbers, lists and dicts else). A series is cut into chunks that run side by side,
    each from a guessed state, as if it began there. Chunks whose guess is not how the one before them ended run again from
    that state, but only until both runs agree; this is repeated until every chunk begins as the one before it ends. Most
    machines forget (a stop is hit, a position closed), so that a few hundred bars of a chunk run again, once; one that never
    does costs a round for each chunk and stays exact. A last pass makes the outputs. No task holds more than a chunk.
    """
    by, chunk = list(by), chunk or CHUNK
    keys = [*by, "_chunk"]
    kept = stored(rows.withColumn("_chunk", F.expr(f"bar_no div {chunk}")), "bars-to-fold")
    small = kept.select(*dict.fromkeys([*keys, "bar_no", *needs]))
    of = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    text = lambda names: ", ".join(f"`{k}` {of[k]}" for k in names)
    starts = None
    if kept.where("_chunk > 0").limit(1).count():
        starts = _starts(small, by, fold, f"{text(keys)}, _begin string, _end string")

    def make(f: pd.DataFrame, begin: pd.DataFrame | None = None) -> pd.DataFrame:
        f = f.sort_values("bar_no")
        known = begin["_begin"].iloc[0] if begin is not None and len(begin) else None
        columns, _ = fold(f, _state(known if isinstance(known, str) else None))
        return f.assign(**{k: np.asarray(columns[k]) for k in outputs})

    schema = ", ".join([text(kept.columns), *(f"`{k}` {t}" for k, t in outputs.items())])
    if starts is None:
        return kept.groupBy(*keys).applyInPandas(lambda f: make(f), schema).drop("_chunk")
    return kept.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(lambda f, b: make(f, b), schema).drop("_chunk")


def _starts(rows: DataFrame, by: list[str], fold: Callable, schema: str) -> DataFrame:
    """The state in which each chunk begins (null: as a series does) and ends."""
    keys = [*by, "_chunk"]

    def guess(f: pd.DataFrame) -> pd.DataFrame:
        end = fold(f.sort_values("bar_no"), None)[1]
        return f[keys].head(1).assign(_begin=None, _end=_line(end))

    def again(f: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        begin, end, true = (None if pd.isna(x) else x for x in at[["_begin", "_end", "_true"]].iloc[0])
        end = run_until_agreed(f.sort_values("bar_no"), fold, _state(begin), _state(true), end)
        return at[keys].head(1).assign(_begin=true, _end=end)

    before = Window.partitionBy(*by).orderBy("_chunk")  # a row for each chunk
    found = stored(rows.groupBy(*keys).applyInPandas(guess, schema), "chunk-ends")
    while True:
        now = stored(found.withColumn("_true", F.lag("_end").over(before)), "chunk-begins")
        wrong = now.where(~F.col("_true").eqNullSafe(F.col("_begin")))
        if not wrong.limit(1).count():
            return found
        on = [F.col(k).eqNullSafe(F.col("_w_" + k)) for k in keys]
        asked = wrong.select(*[F.col(k).alias("_w_" + k) for k in keys])
        todo = rows.join(asked, functools.reduce(lambda a, b: a & b, on), "left_semi")
        done = todo.groupBy(*keys).cogroup(wrong.groupBy(*keys)).applyInPandas(again, schema)
        found = stored(now.where(F.col("_true").eqNullSafe(F.col("_begin"))).drop("_true").unionByName(done), "chunk-ends")


def summed(rows: DataFrame, by: Sequence[str], x: str, total: str, highest: str, before: str | None = None) -> DataFrame:
    """Rows of chunks (``in_chunks``) with the running sum ``total`` of ``x`` along the whole series, in ``highest`` its
    greatest value so far, and in ``before`` the sum up to the row before; copies have none of these.

    A chunk is a segment with its sum and its highest prefix. Segments merge: sums add up, and the highest prefix is that of
    the left one or the left sum and that of the right one. So windows stay within chunks, and one over a row for each
    chunk says what comes before them.
    """
    keys = [*by, "_chunk"]
    w = Window.partitionBy(*keys).orderBy("_block", "bar_no").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("_own"), F.coalesce(F.col(x), F.lit(0.0)))
    rows = rows.withColumn("_part", F.coalesce(F.sum(own).over(w), F.lit(0.0)))
    ends = rows.where("_own").groupBy(*keys).agg(F.max_by("_part", "bar_no").alias("_sum"), F.max("_part").alias("_top"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    ends = ends.withColumn("_high", F.max(F.col("_carry") + F.col("_top")).over(earlier))
    out = rows.join(*by_chunk(ends, keys), "left").drop(*["_k_" + k for k in keys])
    out = out.withColumn(total, F.when(F.col("_own"), F.col("_carry") + F.col("_part")))
    out = out.withColumn(highest, F.greatest(F.col("_high"), F.max(total).over(w)))
    if before:
        out = out.withColumn(before, F.when(F.col("_own"), F.col("_carry") + F.coalesce(F.lag("_part").over(chunk_window(by)), F.lit(0.0))))
    return out.drop("_part", "_carry", "_high", "_sum", "_top")


def by_chunk(table: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``table`` (a row for each chunk) and the condition under which it joins rows of the same chunk, null keys too."""
    return table.withColumnsRenamed({k: "_k_" + k for k in keys}), [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys]


def highest_so_far(rows: DataFrame, by: Sequence[str], piece: Column, order: str, x: str, out: str) -> DataFrame:
    """Adds the greatest ``x`` so far within ``by``. Only rows of one ``piece`` (monotone in the order) meet in a window; the
    greatest of the pieces before comes from one over a row for each piece."""
    keyed, keys = rows.withColumn("_piece", piece), [*by, "_piece"]
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    tops = keyed.groupBy(*keys).agg(F.max(x).alias("_top")).select(*keys, F.max("_top").over(earlier).alias("_high"))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = keyed.join(*by_chunk(tops, keys), "left").drop(*["_k_" + k for k in keys])
    return joined.withColumn(out, F.greatest("_high", F.max(x).over(inside))).drop("_piece", "_high")


def numbered(df: DataFrame, by: Sequence[str], piece: Column, order: Sequence[str], out: str = "rn", add: str | Sequence[str] | None = None, total: str | Sequence[str] = "running") -> DataFrame:
    """Row numbers (from 1) in the order (piece, *order) within ``by``, and with ``add`` the running sums of columns.

    ``piece`` must be monotone in the order (a minute, a day, a stretch of ids). Only rows of one piece meet in a window;
    pieces are put one after another by prefix sums over their counts.
    """
    add = [add] if isinstance(add, str) else list(add or ())
    total = [total] if isinstance(total, str) else list(total)
    keyed = df.withColumn("_piece", piece)
    sums = [F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(add)]]
    sizes = keyed.groupBy(*by, "_piece").agg(*sums)
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias("_0" + c)
    starts = sizes.select(*by, "_piece", before("_n"), *[before(f"_s{i}") for i in range(len(add))])
    inside = Window.partitionBy(*by, "_piece").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = keyed.withColumns({out: F.row_number().over(inside)} | {t: F.sum(x).over(so_far) for t, x in zip(total, add, strict=False)})
    rows = rows.join(starts, [*by, "_piece"]).withColumn(out, F.col(out) + F.col("_0_n"))
    rows = rows.withColumns({t: F.col(t) + F.col(f"_0_s{i}") for i, t in enumerate(total[: len(add)])}) if add else rows
    return rows.drop("_piece", "_0_n", *[f"_0_s{i}" for i in range(len(add))])


def lagged(df: DataFrame, by: Sequence[str], piece: Column, order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Adds, for each {out: column}, the value in the row before in the order (piece, *order) within ``by``. Only rows of one
    piece meet in a window; a piece's first row takes what the last piece before it ends with."""
    keyed = df.withColumn("_piece", piece)
    place = F.struct(*order)
    ends = keyed.groupBy(*by, "_piece").agg(*[F.max_by(F.struct(F.col(c).alias("x")), place).alias(f"_e{i}") for i, c in enumerate(columns.values())])
    earlier = Window.partitionBy(*by).orderBy("_piece")
    ends = ends.select(*by, "_piece", *[F.lag(f"_e{i}").over(earlier).alias(f"_b{i}") for i in range(len(columns))])
    inside = Window.partitionBy(*by, "_piece").orderBy(*order)
    rows = keyed.withColumns({"_n": F.row_number().over(inside)} | {k: F.lag(c).over(inside) for k, c in columns.items()})
    rows = rows.join(ends, [*by, "_piece"])
    rows = rows.withColumns({k: F.when(F.col("_n") == 1, F.col(f"_b{i}.x")).otherwise(F.col(k)) for i, k in enumerate(columns)})
    return rows.drop("_piece", "_n", *[f"_b{i}" for i in range(len(columns))])


def quantiles(df: DataFrame, by: Sequence[str], x: str, at: Sequence[float], cells: int = 4096) -> DataFrame:
    """by, n (values) and quantiles (array of double): exact quantiles with linear interpolation; groups without values are
    left out.

    Values are counted by cell, a cell being one of so many equal stretches of the group's range; running counts say which
    cells hold the wanted ranks, and only the values of these are numbered. Nothing holds a group: the counts have a row
    for each cell, and values of a cell that are alike are one row.
    """
    by = list(by)
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*by, F.col(x).cast("double").alias("_x"))
    ends = rows.groupBy(*by).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count("*").alias("n"))
    share = F.try_divide(F.col("_x") - F.col("_low"), F.col("_high") - F.col("_low"))
    rows = rows.join(ends, by)
    values = rows.groupBy(*by, F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), F.lit(cells - 1)).alias("_cell"), "_x").agg(F.count("*").alias("_k"), F.first("n").alias("n"))
    counts = values.groupBy(*by, "_cell").agg(F.sum("_k").alias("_m"), F.first("n").alias("n"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_c", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("n") - 1)).alias("r")) for i, q in enumerate(at)])
    wanted = counts.select(*by, "_cell", "_c", "_m", F.explode(ranks).alias("_q"))
    wanted = wanted.where((F.floor("_q.r") < F.col("_c") + F.col("_m")) & (F.ceil("_q.r") >= F.col("_c"))).select(*by, "_cell", "_c", "_q")
    cells_wanted = wanted.select(*by, "_cell", "_c").distinct()
    inside = Window.partitionBy(*by, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    held = values.join(cells_wanted, [*by, "_cell"]).withColumn("_to", F.col("_c") + F.sum("_k").over(inside))
    held = held.withColumn("_from", F.col("_to") - F.col("_k")).drop("_c", "n")
    met = held.join(wanted.drop("_c"), [*by, "_cell"]).where((F.floor("_q.r") < F.col("_to")) & (F.ceil("_q.r") >= F.col("_from")))
    low = F.max(F.when((F.floor("_q.r") >= F.col("_from")) & (F.floor("_q.r") < F.col("_to")), F.col("_x")))
    high = F.max(F.when((F.ceil("_q.r") >= F.col("_from")) & (F.ceil("_q.r") < F.col("_to")), F.col("_x")))
    found = met.groupBy(*by, F.col("_q.i").alias("_i"), F.col("_q.r").alias("_r")).agg(low.alias("_l"), high.alias("_h"))
    value = F.col("_l") + (F.col("_r") - F.floor("_r")) * (F.col("_h") - F.col("_l"))
    found = found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", value.alias("v")))), lambda e: e["v"]).alias("quantiles"))
    return found.join(ends.select(*by, "n"), by)
