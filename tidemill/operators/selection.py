"""Results of many sizes and models: means over folds, a ranked comparison with suspects marked, and the choice of one.

Results have bar_size, model, fold and the figures of ``backtest.return_backtest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEANS = ("sharpe", "mdd_pct", "win_rate", "return_pct")


def fold_means(results: DataFrame, *by: str) -> DataFrame:
    """Mean figures over the folds of each combination, and the trades of all."""
    by = by or ("bar_size", "model")
    return results.groupBy(*by).agg(*[F.avg(c).alias(c) for c in MEANS], F.sum("trades").alias("trades"))


def comparison(means: DataFrame, *by: str, high: float = 5.0, few: int = 10) -> DataFrame:
    """In the order of the Sharpe ratio (ties by name), with place and overfitting: a ratio or a number of trades too good or
    too small to be true."""
    order = [F.desc("sharpe"), *(by or ("bar_size", "model"))]
    out = means.withColumn("overfitting", (F.col("sharpe") > high) | (F.col("trades") < few))
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # a row for each combination


def candidates(ranked: DataFrame, min_trades: int = 30, max_mdd_pct: float = 25.0) -> DataFrame:
    return ranked.where((F.col("trades") >= min_trades) & (F.col("mdd_pct") <= max_mdd_pct) & ~F.col("overfitting"))


def chosen(ranked: DataFrame, min_trades: int = 30, max_mdd_pct: float = 25.0) -> DataFrame:
    """The best candidate, or the best of all where there is none; no row without results."""
    fits = (F.col("trades") >= min_trades) & (F.col("mdd_pct") <= max_mdd_pct) & ~F.col("overfitting")
    return ranked.withColumn("candidate", F.coalesce(fits, F.lit(False))).orderBy(F.desc("candidate"), "place").limit(1)
