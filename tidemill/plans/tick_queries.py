"""Queries over the events table as ticks, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators, strategies
from ..operators import bars as B
from . import indicator_sql, recursive_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 20 ticks per symbol and day with bar_no, the input of all series queries."""
    return B.with_bar_no(B.tick_bars(B.event_ticks(spark, sf_dir), 20, per_symbol=True))


def rounded(columns: list[str], exact: tuple[str, ...] = ()) -> list:
    return [c if c in exact else F.round(c, 6).alias(c) for c in columns]


EXACT = ("supertrend_dir", "psar_dir", "squeeze_on", "consec_bull", "consec_bear")

for _name, _columns in indicators.INDICATORS.items():
    _kept = _columns.split()
    if _name == "adx_di":  # adx has gaps where both directions are flat and is a query of its own
        _kept = ["plus_di", "minus_di"]
    query(f"ind_{_name}", indicator_sql.indicator_sql(_name) or recursive_sql.INDICATORS.get(_name))(
        lambda spark, sf_dir, kept=tuple(_kept): indicators.with_indicators(series(spark, sf_dir), kept).select("symbol", "bar_no", *rounded(list(kept), EXACT))
    )

query("ind_adx", recursive_sql.INDICATORS["adx"])(lambda spark, sf_dir: indicators.with_indicators(series(spark, sf_dir), ["adx"]).select("symbol", "bar_no", F.round("adx", 6).alias("adx")))

for _name in strategies.CATEGORIES["ALL"]:
    query(f"sig_{_name.lower()}", indicator_sql.signal_sql(_name) or recursive_sql.SIGNALS.get(_name))(
        lambda spark, sf_dir, name=_name: strategies.with_signals(series(spark, sf_dir), [name]).select("symbol", "bar_no", F.col(name).alias("signal"))
    )
