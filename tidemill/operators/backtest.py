"""Backtests of signals over bar series, in long form: one series per (symbol, bar_size, strategy).

Input rows have symbol, bar_size, strategy, bar_no, open_time, close, signal. Series are cut into chunks of bars; what a
chunk needs of the others (sums, peaks, the change that ends a trade) comes from a row for each chunk, so no window holds a
series, and a grid of sizes and strategies is one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strategies import CATEGORIES, vote
from ..functions.windows import CHUNK, by_chunk, chunk_window, highest_so_far, in_chunks, numbered, own_rows, summed
from ..sources.shared import stored

KEYS = ("symbol", "bar_size", "strategy")


@dataclass(frozen=True)
class Costs:
    """Defaults are fixed values of an index future (capital and multiplier in KRW)."""

    capital: float = 100_000_000.0
    commission: float = 0.00003
    slippage_ticks: float = 1.0
    tick_value: float = 0.05
    multiplier: float = 250_000.0
    flat_at: str = "15:35:00"
    short: bool = True


#: Tick value, multiplier and currency of contracts.
CONTRACTS = {
    "NQ": (0.25, 20.0, "USD"), "MNQ": (0.25, 2.0, "USD"), "CL": (0.01, 1000.0, "USD"), "GC": (0.10, 100.0, "USD"), "ES": (0.25, 50.0, "USD"),
    "MES": (0.25, 5.0, "USD"), "6E": (0.00005, 125000.0, "USD"), "CUSTOM": (0.25, 20.0, "USD"),
}
WON_PER_DOLLAR = 1350.0


def contract_costs(symbol: str, capital: float, **more) -> Costs:
    """Costs of a contract; capital of a million or more is taken as KRW and turned into dollars."""
    tick, multiplier, _ = CONTRACTS.get(symbol.upper(), CONTRACTS["CUSTOM"])
    dollars = capital / WON_PER_DOLLAR if capital >= 1_000_000 else capital
    return Costs(capital=dollars, tick_value=tick, multiplier=multiplier, **more)


def long_signals(rows: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """One row per bar and strategy from a column per strategy."""
    pairs = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("signal")) for s in strategies])
    keep = [c for c in ("symbol", "bar_size", "bar_no", "open_time", "close", "volume", "_chunk", "_own", "_block", "_at") if c in rows.columns]
    return rows.select(*keep, F.inline(pairs))


def _keys(df: DataFrame) -> list[str]:
    return [k for k in KEYS if k in df.columns]


def equity(rows: DataFrame, costs: Costs | None = None, strategies: Sequence[str] | None = None) -> DataFrame:
    """Adds position, turned (it differs from that of the bar before), cash (net of costs), cum_cash, equity, drawdown_pct,
    bar_ret and day. With ``strategies`` rows are bars with a column for each; they are dealt as such and become long after.

    A series (with bar_no, from 0 without gaps) is read in chunks that overlap by the bars which a position depends on; sums
    and peaks are those of segments that merge (``windows.summed``).
    """
    costs, keys = costs or Costs(), _keys(rows)
    out = in_chunks(rows, keys, 2, 1)
    if strategies:
        out, keys = long_signals(out, strategies), [*keys, "strategy"]
    w = chunk_window(keys)
    position = F.lag("signal", 1, 0).over(w)
    out = out.withColumn("position", position if costs.short else F.greatest(position, F.lit(0))).withColumn("day", F.to_date("open_time"))
    if costs.flat_at.upper() not in ("NONE", "24H", "OFF", "FALSE", ""):
        late = F.date_format("open_time", "HH:mm:ss") >= costs.flat_at
        out = out.withColumn("position", F.when(late | ~F.col("day").eqNullSafe(F.lead("day").over(w)), 0).otherwise(F.col("position")))
    out = out.withColumn("turned", ~F.col("position").eqNullSafe(F.lag("position").over(w)))
    before = F.lag("position", 1, 0).over(w)
    turn = F.abs(F.col("position") - before)
    move = F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))
    points = before * move - turn * (costs.slippage_ticks * costs.tick_value) - turn * F.col("close") * costs.commission
    out = summed(out.withColumn("cash", points * costs.multiplier), keys, "cash", "cum_cash", "_peak", "_before")
    peak = F.col("_peak") + costs.capital
    out = own_rows(out).withColumn("equity", F.col("cum_cash") + costs.capital)
    out = out.withColumn("drawdown_pct", (F.col("equity") - peak) / peak * 100).withColumn("bar_ret", F.col("cash") / (F.col("_before") + costs.capital))
    return out.drop("_peak", "_before")


def trades(curve: DataFrame) -> DataFrame:
    """Stretches of one position, to the bar at which it changes (which belongs to both) or the last one.

    A chunk knows its own changes and what it begins and ends with; the change that ends its last stretch is the first one
    of the chunks after it, and the number and profit of earlier trades are sums over the chunks before.
    """
    keys = _keys(curve)
    parts = ("bar_no", "open_time", "close", "cum_cash")
    end, at_turn = F.struct(*parts), F.when(F.col("turned"), F.col("bar_no"))
    rows = curve.withColumns({"_chunk": F.expr(f"bar_no div {CHUNK}"), "_block": F.lit(0)})
    flat = [F.max_by(c, "bar_no").alias(f"_l_{c}") for c in parts] + [F.min_by(c, at_turn).alias(f"_f_{c}") for c in parts]  # numbers, which hash tables hold
    struct = lambda k: F.struct(*[F.col(f"_{k}_{c}").alias(c) for c in parts])
    ends = rows.groupBy(*keys, "_chunk").agg(*flat).select(*keys, "_chunk", struct("l").alias("_last"), F.when(F.col("_f_bar_no").isNotNull(), struct("f")).alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumns({"_after": F.first("_first", True).over(later), "_final": F.max("_last").over(Window.partitionBy(*keys))}).drop("_first", "_last")
    chunk = [*keys, "_chunk"]
    rows = rows.where("turned").join(*by_chunk(ends, chunk)).drop(*["_k_" + k for k in chunk])
    rows = rows.withColumn("_end", F.coalesce(F.lead(end).over(chunk_window(keys)), "_after", "_final"))
    rows = rows.where((F.col("position") != 0) & (F.col("_end.bar_no") > F.col("bar_no")))
    points = (F.col("_end.close") - F.col("close")) * F.col("position")
    pnl = F.bround(F.col("_end.cum_cash") - F.col("cum_cash") + F.col("cash"), 2)
    out = rows.select(
        *keys, "_chunk", "bar_no", F.col("open_time").alias("entry_time"), F.col("_end.open_time").alias("exit_time"),
        F.when(F.col("position") > 0, "LONG").otherwise("SHORT").alias("side"), F.col("close").alias("entry_price"), F.col("_end.close").alias("exit_price"),
        F.bround(points, 2).alias("pts_pnl"), pnl.alias("pnl"), F.bround(F.try_divide(points, F.col("close")) * 100, 2).alias("ret_pct"),
        (F.col("_end.bar_no") - F.col("bar_no") + 1).alias("bars_held"),
    )
    out = numbered(out, keys, F.col("_chunk"), ["bar_no"], "trade_no", "pnl", "cum_pnl")
    figures = [c for c in out.columns if c not in (*keys, "_chunk", "bar_no", "trade_no", "cum_pnl")]
    return out.select(*keys, F.col("trade_no").cast("bigint").alias("trade_no"), *figures, "cum_pnl")


def with_empty(results: DataFrame, series: DataFrame) -> DataFrame:
    """``results`` with a row of zeros for each of the ``series`` (rows of the same keys) that has none, as it has no bars."""
    return series.distinct().join(results, _keys(series), "left").na.fill(0)


def summary(curve: DataFrame, costs: Costs | None = None) -> DataFrame:
    """One row per series: return, drawdown, trade statistics and daily risk figures."""
    costs = costs or Costs()
    keys = _keys(curve)
    won = F.col("pnl") > 0
    deals = trades(curve).groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.count_if(won).alias("win_trades"), F.coalesce(F.sum(F.when(won, F.col("pnl"))), F.lit(0.0)).alias("gross_win"),
        F.abs(F.coalesce(F.sum(F.when(~won, F.col("pnl"))), F.lit(0.0))).alias("gross_loss"), F.avg(F.when(won, F.col("pnl"))).alias("avg_win"),
        F.abs(F.avg(F.when(~won, F.col("pnl")))).alias("avg_loss"), F.avg("ret_pct").alias("avg_trade_pct"),
    )
    days = curve.groupBy(*keys, "day").agg(F.sum("bar_ret").alias("day_ret"))
    risk = days.groupBy(*keys).agg(F.avg("day_ret").alias("mean"), F.stddev_samp("day_ret").alias("sd"), F.stddev_samp(F.when(F.col("day_ret") < 0, F.col("day_ret"))).alias("down"))
    whole = curve.groupBy(*keys).agg(
        F.count("*").alias("bars"), F.max_by("equity", "bar_no").alias("final"), F.min("drawdown_pct").alias("worst"), F.min("open_time").alias("t0"), F.max("open_time").alias("t1")
    )
    whole = whole.withColumn("total_return_pct", (F.col("final") / costs.capital - 1) * 100).withColumn("mdd_pct", F.abs("worst"))
    factor, n_days = 1 + F.col("total_return_pct") / 100, F.greatest(F.lit(1), F.expr("timestampdiff(DAY, t0, t1)"))
    out = whole.join(deals, keys, "left").join(risk, keys)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    root = 252**0.5
    return out.select(
        *keys, "bars", F.coalesce("total_trades", F.lit(0)).alias("total_trades"), "total_return_pct",
        F.when(factor > 0, (F.pow(F.greatest(factor, F.lit(1e-300)), F.lit(365.0) / n_days) - 1) * 100).otherwise(F.col("total_return_pct")).alias("annual_return_pct"), "mdd_pct",
        zero(F.col("win_trades") / F.col("total_trades") * 100).alias("win_rate"),
        F.when(F.col("gross_loss") > 0, F.col("gross_win") / F.nullif(F.col("gross_loss"), F.lit(0.0))).when(F.col("gross_win") > 0, 999.0).otherwise(0.0).alias("profit_factor"),
        zero(F.try_divide(F.coalesce("avg_win", F.lit(0.0)), F.nullif(F.col("avg_loss"), F.lit(0.0)))).alias("payoff_ratio"), zero(F.col("avg_trade_pct")).alias("avg_trade_pct"),
        zero(F.col("sd") * root * 100).alias("annual_vol_pct"), zero(F.try_divide(F.col("mean") * 252, F.nullif(F.col("sd"), F.lit(0.0)) * root)).alias("sharpe"),
        zero(F.try_divide(F.col("mean") * 252, F.nullif(F.col("down"), F.lit(0.0)) * root)).alias("sortino"),
    )


def asked_series(results: DataFrame, series: DataFrame) -> DataFrame:
    """A row of ``results`` for each of ``series`` (rows of keys, repeats once): its own, or zeros where it has no bars.

    Keys may be null; results of series that aren't asked for are left out; columns other than numbers stay null.
    """
    keys, numbers = series.columns, [c for c, kind in results.dtypes if kind in ("int", "bigint", "float", "double")]
    left, right = series.distinct().alias("s"), results.withColumn("_found", F.lit(True)).alias("r")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    zero = lambda c: F.when(F.col("r._found"), F.col(f"r.{c}")).otherwise(F.lit(0)).cast(dict(results.dtypes)[c]).alias(c)
    out = left.join(right, on, "left")
    return out.select(*[F.col(f"s.{c}") if c in keys else zero(c) if c in numbers else F.col(f"r.{c}") for c in results.columns])


def breakdown(curve: DataFrame, period: str, costs: Costs | None = None) -> DataFrame:
    """Per year ('yyyy') or month ('yyyy-MM'): return on the initial capital, drawdown from the period's own peak, trades by entry."""
    costs = costs or Costs()
    keys = _keys(curve)
    rows = curve.withColumn("period", F.date_format("open_time", period))
    rows = highest_so_far(rows, [*keys, "period"], F.expr(f"bar_no div {CHUNK}"), "bar_no", "equity", "_peak")
    rows = rows.withColumn("_dd", (F.col("equity") - F.col("_peak")) / F.col("_peak") * 100)
    money = rows.groupBy(*keys, "period").agg(F.sum("cash").alias("net_pnl"), F.abs(F.min("_dd")).alias("mdd_pct"))
    deals = trades(curve).groupBy(*keys, F.date_format("entry_time", period).alias("period")).agg(F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"))
    out = money.join(deals, [*keys, "period"], "left")
    return out.select(
        *keys, "period", F.bround(F.col("net_pnl") / costs.capital * 100, 2).alias("return_pct"), F.bround("net_pnl", 2).alias("net_pnl"), F.bround("mdd_pct", 2).alias("mdd_pct"),
        F.coalesce("trades", F.lit(0)).alias("trades"), F.bround(F.coalesce(F.try_divide(F.col("wins"), F.col("trades")) * 100, F.lit(0.0)), 1).alias("win_rate"),
    )


def rank_matrix(results: DataFrame) -> DataFrame:
    """Results in the order of Sharpe ratio, then return, with their place (ties by name)."""
    order = [F.desc("sharpe"), F.desc("total_return_pct"), *_keys(results)]
    return results.withColumn("place", F.row_number().over(Window.orderBy(*order))).orderBy("place")


def best(results: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best strategies of each (symbol, bar_size) by the given columns, descending (ties by name)."""
    keys = [x for x in _keys(results) if x != "strategy"]
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by], "strategy")
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def ensembles(rows: DataFrame, names: Sequence[str] = ("TREND", "MOMENTUM", "VOLATILITY", "CONTRARIAN", "ALL")) -> DataFrame:
    """Adds <category>_Ensemble columns to rows that have every strategy of the categories as a column."""
    return rows.withColumns({f"{n}_Ensemble": vote(CATEGORIES[n]).cast("int") for n in names})


def top_votes(signals: DataFrame, results: DataFrame) -> DataFrame:
    """Long signals of Top3, Top5 (by return, Sharpe) and Top3_WinRate (by win rate, return): each series' best singles vote."""
    keys = [x for x in _keys(signals) if x != "strategy"]
    chosen = None
    for name, k, by in (("Top3_Ensemble", 3, ("total_return_pct", "sharpe")), ("Top5_Ensemble", 5, ("total_return_pct", "sharpe")), ("Top3_WinRate_Ensemble", 3, ("win_rate", "total_return_pct"))):
        part = best(results, k, *by).select(*keys, "strategy", F.lit(name).alias("ensemble"))
        chosen = part if chosen is None else chosen.unionByName(part)
    at = signals.join(chosen, [*keys, "strategy"]).groupBy(*keys, "ensemble", "bar_no").agg(F.min("open_time").alias("open_time"), F.min("close").alias("close"), F.avg("signal").alias("mean"))
    vote_ = F.when(F.col("mean") > 0.2, 1).when(F.col("mean") < -0.2, -1).otherwise(0)
    return at.select(*keys, F.col("ensemble").alias("strategy"), "bar_no", "open_time", "close", vote_.alias("signal"))


def grid(rows: DataFrame, strategies: Sequence[str], costs: Costs | None = None, least_bars: int = 20, with_votes: bool = True) -> DataFrame:
    """Summaries of all strategies (columns of ``rows``) on every series of ``least_bars`` or more, with the votes of the best."""
    keys = [k for k in ("symbol", "bar_size") if k in rows.columns]
    rows = stored(rows, "bars-with-signals")
    enough = rows.groupBy(*keys).count().where(F.col("count") >= least_bars).select(*keys)
    # Indicators and signals are made once, and so is each equity curve, which a summary reads several times. What is dealt is
    # bars, not a row for each strategy.
    rows = rows.join(enough, keys, "left_semi")
    singles = stored(summary(stored(equity(rows, costs, strategies), "curves"), costs), "summaries")
    if not with_votes or len(strategies) < 3:
        return singles
    votes = stored(top_votes(long_signals(rows, strategies), singles), "votes")
    return singles.unionByName(summary(stored(equity(votes, costs), "curves"), costs))


def trade_cost(entry: Column, exit_: Column, quantity: float = 1.0, volume: Column | None = None, mode: str = "fixed_and_volume", rate: float = 0.00003, tick: float = 0.05, impact: float = 0.00001) -> Column:
    """Cost of a round trip in points: commission of both sides, and slippage by ``mode`` (fixed, volume or both)."""
    out = (entry + exit_) * rate
    if mode in ("fixed", "fixed_and_volume"):
        out = out + 2 * tick
    if mode in ("volume", "fixed_and_volume"):
        out = out + 2 * (quantity / F.greatest(F.lit(1.0), volume if volume is not None else F.lit(1000.0))) * impact * entry
    return out


def return_backtest(rows: DataFrame, threshold: float = 0.0005, money_per_point: float = 250_000.0, **cost) -> DataFrame:
    """Multiplicative backtest of signals (columns symbol, bar_no, close, volume, signal); one row per series.

    Whole-number signals are positions as they are; real ones are long or short beyond the threshold. Costs are the
    round-trip points of each change over the price; annual figures scale by the number of bars. A series of fewer than two
    bars has zeros throughout.
    """
    keys = _keys(rows)
    w = chunk_window(keys)
    whole = dict(rows.dtypes)["signal"] in ("tinyint", "smallint", "int", "bigint")
    side = F.col("signal") if whole else F.when(F.col("signal") > threshold, 1).when(F.col("signal") < -threshold, -1).otherwise(0)
    out = in_chunks(rows, keys, 2).withColumn("side", side).withColumn("held", F.lag("side", 1, 0).over(w))
    turn = F.abs(F.col("held") - F.lag("held", 1, 0).over(w))
    prior = F.lag("close").over(w)
    gross = F.coalesce((F.col("close") - prior) / F.greatest(prior, F.lit(1e-6)), F.lit(0.0)) * F.col("held")
    out = out.withColumn("turn", turn).withColumn("gross", gross)
    out = out.withColumn("points", F.when(F.col("turn") > 0, trade_cost(F.col("close"), F.col("close"), volume=F.col("volume"), **cost)).otherwise(0.0))
    out = out.withColumn("net", F.col("gross") - F.col("points") / F.greatest(F.lit(1.0), F.col("close")))
    out = own_rows(summed(out.withColumn("_log", F.log1p(F.greatest("net", F.lit(-0.999999)))), keys, "_log", "_grown", "_summit"))
    out = out.withColumn("curve", F.exp("_grown")).withColumn("dd", F.col("curve") / F.exp("_summit") - 1)
    n, up, down = F.count("*"), F.sum(F.when(F.col("net") > 0, F.col("net"))), F.abs(F.sum(F.when(F.col("net") < 0, F.col("net"))))
    agg = out.groupBy(*keys).agg(
        n.alias("bars"), F.max_by("curve", "bar_no").alias("final"), F.min("dd").alias("dd"), F.avg("net").alias("mean"), F.stddev_pop("net").alias("sd"),
        F.stddev_pop(F.when(F.col("net") < 0, F.col("net"))).alias("down"), F.count_if(F.col("turn") > 0).alias("changes"), F.coalesce(up, F.lit(0.0)).alias("up"), down.alias("loss"),
        F.count_if(F.col("net") > 0).alias("wins"), F.count_if(F.col("net") < 0).alias("losses"), F.avg("close").alias("price"), F.sum("points").alias("points"),
    )
    root = F.sqrt("bars")
    ratio = lambda c: F.when(F.col(c) > 0, F.col("mean") / (F.col(c) + 1e-8) * root).otherwise(0.0)
    figures = {
        "return_pct": (F.col("final") - 1) * 100, "annual_return_pct": F.when(F.col("mean") > -0.99, (F.pow(1 + F.col("mean"), F.col("bars")) - 1) * 100).otherwise(-99.9),
        "mdd_pct": F.abs(F.col("dd") * 100), "sharpe": ratio("sd"), "sortino": ratio("down"), "win_rate": F.coalesce(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")) * 100, F.lit(0.0)),
        "profit_factor": F.when(F.col("losses") > 0, F.col("up") / F.greatest(F.lit(1e-8), F.col("loss"))).otherwise(1.0), "expectancy_pts": F.col("mean") * F.col("price"),
        "total_cost": F.col("points") * money_per_point, "trades": F.greatest(F.lit(1).cast("bigint"), F.expr("changes div 2")),
    }
    return agg.select(*keys, "bars", *[F.when(F.col("bars") < 2, F.lit(0)).otherwise(x).cast("bigint" if k == "trades" else "double").alias(k) for k, x in figures.items()])
