"""Two looks at bar sizes: a coarse grid over the whole range, then a fine one around the sizes that did best.

Both looks are made of one table of bars whose size divides all that can come up, so ticks are read and numbered once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import bars as B
from .selection import chosen, comparison, fold_means


def coarse_to_fine(
    ticks: DataFrame, score: Callable[[DataFrame], DataFrame], start: int, end: int, coarse_step: int, fine_step: int, reach: int, top: int = 1, per_symbol: bool = True,
    min_trades: int = 30, max_mdd_pct: float = 25.0,
) -> DataFrame:
    """``bar_size, model, stage`` (1 coarse, 2 fine), mean figures, place, overfitting and is_chosen for each size looked at.

    score: bars with bar_no to results by bar_size, model and series (``backtest.return_backtest``). The ``top`` sizes by
    Sharpe ratio (ties by size) of the first look are the centres of the second, which leaves out sizes already seen. The
    choice among all is ``selection.chosen``. No ticks give no row.
    """
    if start <= 0 or end < start or min(coarse_step, fine_step) <= 0 or reach < 0:
        raise ValueError("a sweep needs 0 < start <= end, positive steps and a reach of 0 or more")
    unit = math.gcd(start, end, coarse_step, fine_step, reach)
    if (start % unit or end % unit) or unit < B.LEAST_UNIT:
        parts = None
    else:
        parts = stored(B.unit_bars(ticks, unit, per_symbol), "unit-bars")

    def look(sizes: list[int], stage: int) -> DataFrame:
        bars = B.of_units(parts, sizes, unit) if parts is not None else B.tick_bars(ticks, sizes, per_symbol)
        means = fold_means(score(stored(B.with_bar_no(bars), "bars")), "bar_size", "model")
        return stored(means.withColumn("stage", F.lit(stage)), "look")

    coarse = B.coarse_sizes(start, end, coarse_step)
    found = look(coarse, 1)
    ranked = found.groupBy("bar_size").agg(F.max("sharpe").alias("sharpe")).orderBy(F.desc("sharpe"), "bar_size")
    best = [r.bar_size for r in ranked.limit(top).collect()]
    fine = sorted(set(B.fine_sizes(best, reach, fine_step, start, end)) - set(coarse))
    if fine:
        found = found.unionByName(look(fine, 2))
    ranked = stored(comparison(found, "bar_size", "model"), "ranked")
    one = chosen(ranked, min_trades, max_mdd_pct).select(F.col("place").alias("_place"))
    return ranked.join(F.broadcast(one), F.col("place") == F.col("_place"), "left").withColumn("is_chosen", F.col("_place").isNotNull()).drop("_place")
