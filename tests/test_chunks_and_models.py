"""State machines and backtests in small chunks against whole series, boosted trees and the search against plain versions,
the bar cache and the coarse-to-fine sweep."""

import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_recurrences import walk

from tidemill.functions import indicators, strategies, windows
from tidemill.operators import backtest as T
from tidemill.operators import bars as B
from tidemill.operators import boosting, search, sweep
from tidemill.operators import learning as L
from tidemill.plans import more_queries, registry
from tidemill.sources import bar_cache
from tidemill.sources.shared import stored

MACHINES = ["Supertrend", "Parabolic_SAR", *strategies.BREAKOUTS, *strategies.TRIGGERS]


def two_series(n):
    a, b = walk(n, 5), walk(n // 2, 6)
    b["symbol"] = "y"
    return [*a.itertuples(index=False), *b.itertuples(index=False)], list(a.columns)


# ---- state machines ----


def test_state_machines_in_chunks(spark):
    rows, names = two_series(700)
    bars = spark.createDataFrame(rows, names)
    by = ["symbol", "bar_size"]
    ready = indicators.with_indicators(bars, ["_st_up", "_st_low"])
    for name, (outs, needs, fold) in indicators.MACHINES.items():
        whole = windows.folded(ready, by, fold, outs, needs)
        parts = windows.folded(ready, by, fold, outs, needs, chunk=37)
        order = lambda df: sorted(tuple(r) for r in df.select(*by, "bar_no", *outs).collect())  # noqa: E731, B023
        assert order(whole) == order(parts) and len(order(parts)) == len(rows), name


def test_strategies_in_chunks(spark, monkeypatch):
    rows, names = two_series(600)
    bars = spark.createDataFrame(rows, names)
    looped = [n for n in strategies.STATEFUL]
    want = sorted(map(tuple, strategies.with_signals(bars, looped).select("symbol", "bar_no", *looped).collect()))
    real = windows.folded
    monkeypatch.setattr(strategies, "folded", lambda *a: real(*a, chunk=50))
    got = sorted(map(tuple, strategies.with_signals(bars, looped).select("symbol", "bar_no", *looped).collect()))
    assert got == want and any(any(r[2:]) for r in got)


def test_one_pass_of_all_machines_over_evenly_dealt_chunks(spark, monkeypatch):
    """All stops and rules run in one pass, which isn't led by columns that nothing reads, and the windows before it are dealt
    to all tasks however few bytes the bars have."""
    rows, names = two_series(300)
    bars, seen, real = spark.createDataFrame(rows, names), [], windows.folded
    count = lambda rows, *a: (seen.append(rows.columns), real(rows, *a))[1]
    monkeypatch.setattr(strategies, "folded", count)
    monkeypatch.setattr(indicators, "folded", count)
    mixed = ["Supertrend", "Parabolic_SAR", "RSI", "Contrarian_BB_PinBar"]
    got = strategies.with_signals(bars, mixed)
    assert len(seen) == 1 and "rsi" not in seen[0] and "_tr" not in seen[0]
    monkeypatch.undo()
    alone = strategies.with_signals(bars, ["Parabolic_SAR"]).select("symbol", "bar_no", "Parabolic_SAR").collect()
    assert sorted(map(tuple, got.select("symbol", "bar_no", "Parabolic_SAR").collect())) == sorted(map(tuple, alone))
    rows = windows.in_chunks(bars, ["symbol", "bar_size"], 0)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.rdd.getNumPartitions() == n == windows.carried(rows, ["symbol", "bar_size"], {"_last": F.col("close")}).rdd.getNumPartitions()


def test_machine_that_never_forgets(spark):
    """A count of all bars so far: no chunk's guess is right, and every round settles one more."""
    def fold(f, state):
        total = (state or 0) + np.cumsum(np.ones(len(f)))
        return {"seen": total.astype(int)}, float(total[-1])

    bars = spark.createDataFrame([(s, 1, i) for s in "ab" for i in range(100)], "symbol string, bar_size int, bar_no bigint")
    out = windows.folded(bars, ["symbol", "bar_size"], fold, {"seen": "int"}, [], chunk=20)
    assert out.where("seen <> bar_no + 1").count() == 0 and out.count() == 200
    assert windows.folded(bars.limit(0), ["symbol"], fold, {"seen": "int"}, []).count() == 0


def test_runs_end_where_they_agree():
    seen = []

    def fold(f, state):
        """Forgets at every hundredth bar."""
        seen.append(len(f))
        for i in f["bar_no"]:
            state = 0 if i % 100 == 0 else (state or 0) + 1
        return {}, state

    import pandas as pd

    f = pd.DataFrame({"bar_no": range(50, 5050)})
    assert windows.run_until_agreed(f, fold, None, 7, "end") == "end" and sum(seen) == 2 * windows.COMPARE
    seen.clear()
    assert windows.run_until_agreed(f.head(40), fold, None, 7, "end") == "47"


def test_a_mean_that_outlives_its_lead_raises(spark):
    with pytest.raises(ValueError, match="remembers more"):
        windows.ewm_steps("m", "close", ["symbol"], span=400)
    windows.ewm_steps("m", "close", ["symbol"], span=200)


# ---- backtests ----


def signals(spark, n=900, seed=2):
    rng, rows = np.random.default_rng(seed), []
    for strategy, hold in (("a", 9), ("b", 200), ("flat", 1)):
        signal = np.repeat(rng.integers(-1, 2, n // hold + 1), hold)[:n] * (strategy != "flat")
        close = 350 + np.cumsum(rng.normal(0, 0.3, n))
        for i in range(n):
            day, minute = divmod(i, 390)
            rows.append(("x", 20, strategy, i, np.datetime64("2024-01-01T09:00") + np.timedelta64(day * 1440 + minute, "m"), float(close[i]), int(5 + i % 7), int(signal[i])))
    rows = [(*r[:4], r[4].astype("datetime64[us]").item(), *r[5:]) for r in rows]
    return spark.createDataFrame(rows, "symbol string, bar_size int, strategy string, bar_no bigint, open_time timestamp_ntz, close double, volume bigint, signal int")


def plain_curve(rows, costs):
    """One series, bar by bar."""
    out, cum, peak = [], 0.0, -math.inf
    day = [r.open_time.date() for r in rows]
    late = lambda i: r"{:%H:%M:%S}".format(rows[i].open_time) >= costs.flat_at or i + 1 == len(rows) or day[i + 1] != day[i]
    held = [0 if late(i) else (rows[i - 1].signal if i else 0) for i in range(len(rows))]
    for i, r in enumerate(rows):
        before = held[i - 1] if i else 0
        turn, move = abs(held[i] - before), r.close - rows[i - 1].close if i else 0.0
        cash = (before * move - turn * costs.slippage_ticks * costs.tick_value - turn * r.close * costs.commission) * costs.multiplier
        was, cum = costs.capital + cum, cum + cash
        peak = max(peak, costs.capital + cum)
        out.append((r.bar_no, held[i], cash, costs.capital + cum, (costs.capital + cum - peak) / peak * 100, cash / was))
    return out


def plain_trades(rows, curve):
    starts = [i for i in range(len(curve)) if not i or curve[i][1] != curve[i - 1][1]]
    out, total = [], 0.0
    for i, j in zip(starts, [*starts[1:], len(curve) - 1]):
        if curve[i][1] and j > i:
            pnl = round(curve[j][3] - curve[i][3] + curve[i][2], 2)
            total += pnl
            out.append((len(out) + 1, "LONG" if curve[i][1] > 0 else "SHORT", rows[i].close, rows[j].close, j - i + 1, pnl, total))
    return out


@pytest.mark.parametrize("chunk", [16384, 50])
def test_backtests_in_segments(spark, monkeypatch, chunk):
    monkeypatch.setattr(windows, "CHUNK", chunk)
    monkeypatch.setattr(T, "CHUNK", chunk)
    rows, costs = signals(spark), T.Costs()
    curve = T.equity(rows, costs)
    for strategy in ("a", "b", "flat"):
        series = sorted(rows.where(F.col("strategy") == strategy).collect(), key=lambda r: r.bar_no)
        got = sorted(curve.where(F.col("strategy") == strategy).select("bar_no", "position", "cash", "equity", "drawdown_pct", "bar_ret").collect())
        want = plain_curve(series, costs)
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert tuple(g) == pytest.approx(w, rel=1e-9, abs=1e-7)
        deals = sorted(T.trades(curve).where(F.col("strategy") == strategy).select("trade_no", "side", "entry_price", "exit_price", "bars_held", "pnl", "cum_pnl").collect())
        plain = plain_trades(series, want)
        assert [tuple(d[:5]) for d in deals] == [w[:5] for w in plain]
        money = lambda rows: np.array([r[5:] for r in rows], float).reshape(-1, 2)
        assert np.allclose(money(deals), money(plain), atol=0.02 * len(deals) + 0.02)
    years = T.breakdown(curve, "yyyy-MM-dd", costs).where("strategy = 'a'").collect()
    assert len(years) == 3 and all(r.mdd_pct >= 0 for r in years)


def test_return_backtest_in_segments(spark, monkeypatch):
    rows = signals(spark)
    want = sorted(T.return_backtest(rows).collect(), key=lambda r: r.strategy)
    plain = sorted(T.breakdown(T.equity(rows), "yyyy-MM-dd").collect())
    monkeypatch.setattr(windows, "CHUNK", 40)
    monkeypatch.setattr(T, "CHUNK", 40)
    for g, w in zip(sorted(T.return_backtest(rows).collect(), key=lambda r: r.strategy), want, strict=True):
        assert tuple(g[:3]) == tuple(w[:3]) and tuple(g[3:]) == pytest.approx(tuple(w[3:]), rel=1e-9, abs=1e-9)
    assert sorted(T.breakdown(T.equity(rows), "yyyy-MM-dd").collect()) == plain
    empty = spark.createDataFrame([("x", 20, "a"), ("x", 20, "none")], "symbol string, bar_size int, strategy string")
    got = {r.strategy: r for r in T.with_empty(T.return_backtest(rows), empty).collect()}
    assert got["none"].bars == 0 and got["none"].sharpe == 0 and got["none"].trades == 0 and got["a"].bars == 900


def test_grid_against_single_backtests(spark):
    """Each row of the grid is the backtest of its strategy alone; the votes of the best come from these rows."""
    ticks = B.event_ticks(spark, SF).where("symbol in ('click', 'view')")
    bars = stored(B.with_bar_no(B.tick_bars(ticks, [20, 40], per_symbol=True)), "bars")
    names = ["EMA_Cross", "RSI", "Donchian_Channel", "Supertrend"]
    rows = stored(strategies.with_signals(bars, names), "rows")
    got = {(r.symbol, r.bar_size, r.strategy): r for r in T.grid(rows, names, least_bars=12).collect()}
    counts = {(r.symbol, r.bar_size): r["count"] for r in bars.groupBy("symbol", "bar_size").count().collect()}
    votes = ["Top3_Ensemble", "Top5_Ensemble", "Top3_WinRate_Ensemble"]
    assert set(got) == {(*k, s) for k, n in counts.items() if n >= 12 for s in [*names, *votes]}
    for name in names[2:]:
        for r in T.summary(T.equity(T.long_signals(rows, [name]))).collect():
            if (r.symbol, r.bar_size, name) in got:
                assert tuple(got[r.symbol, r.bar_size, name])[3:] == pytest.approx(tuple(r)[3:])
    singles = stored(T.grid(rows, names, least_bars=12, with_votes=False), "singles")
    votes_made = T.top_votes(T.long_signals(rows, names), singles).where("strategy = 'Top3_Ensemble'").collect()
    signal = {(r.symbol, r.bar_size, r.bar_no): r for r in rows.collect()}
    for key in {k[:2] for k in got}:
        first = sorted(names, key=lambda n: (-got[(*key, n)].total_return_pct, -got[(*key, n)].sharpe, n))[:3]
        means = {k[2]: sum(r[n] for n in first) / 3 for k, r in signal.items() if k[:2] == key}
        made = {r.bar_no: r.signal for r in votes_made if (r.symbol, r.bar_size) == key}
        assert made == {i: 1 if m > 0.2 else -1 if m < -0.2 else 0 for i, m in means.items()}


def test_curves_of_strategies_as_columns(spark):
    """Bars are dealt and become a row for each strategy after that; the curves are those of long signals, trades too."""
    rows, columns = two_series(90)
    bars = spark.createDataFrame(rows, columns).withColumn("open_time", F.expr("timestamp_ntz'2024-01-02 10:00:00' + make_dt_interval(0, bar_no)"))
    wide = stored(bars.withColumns({"up": F.expr("cast(bar_no % 7 > 3 as int)"), "down": F.expr("cast(-(bar_no div 30) % 2 as int)")}), "wide")
    got, want = T.equity(wide, None, ["up", "down"]), T.equity(T.long_signals(wide, ["up", "down"]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("REPARTITION_BY_NUM")
    order = lambda df: sorted(map(tuple, df.select(*sorted(want.columns)).collect()), key=str)
    assert order(got) == order(want) and got.count() == 2 * len(rows)
    assert sorted(map(tuple, T.trades(stored(got, "got")).collect())) == sorted(map(tuple, T.trades(stored(want, "want")).collect()))


# ---- boosted trees and the search ----


def plain_boosting(x, y, cuts, shape):
    """All rows in one array; gradients are not made whole."""
    classes = sorted(set(y))
    base = np.log([np.mean(y == c) for c in classes])
    codes = np.stack([np.where(np.isnan(x[:, j]), 0, (x[:, [j]] >= np.array(c)).sum(1) + 1) for j, c in enumerate(cuts)], 1)
    scores = np.tile(base, (len(x), 1))
    for _ in range(shape.rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        for k, c in enumerate(classes):
            g, h = p[:, k] - (y == c), p[:, k] * (1 - p[:, k])
            groups = [np.arange(len(x))]
            for _ in range(shape.depth):
                after = []
                for rows in groups:
                    found = (0.0, None)
                    for j in range(x.shape[1]):
                        for cell in range(int(codes[:, j].max())):
                            left = codes[rows, j] <= cell
                            a, b, s, t = g[rows][left].sum(), h[rows][left].sum(), g[rows].sum(), h[rows].sum()
                            if b >= shape.least_weight and t - b >= shape.least_weight:
                                gain = a * a / (b + shape.l2) + (s - a) ** 2 / (t - b + shape.l2) - s * s / (t + shape.l2)
                                if gain > found[0] + 1e-6:
                                    found = (gain, left)
                    after += [rows[found[1]], rows[~found[1]]] if found[1] is not None else [rows, rows[:0]]
                groups = after
            for rows in groups:
                scores[rows, k] -= shape.rate * g[rows].sum() / (h[rows].sum() + shape.l2)
    return np.array(classes)[scores.argmax(1)], np.exp(scores) / np.exp(scores).sum(1, keepdims=True)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(260, 4)).round(2)
    x[rng.random(x.shape) < 0.05] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) + 0.3 * rng.normal(size=260) > 0.5, 1, np.where(np.nan_to_num(x[:, 1]) * np.nan_to_num(x[:, 2]) > 0.2, -1, 0))
    rows = [(i, *[None if math.isnan(v) and i % 2 else float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, d double, label int")


@pytest.mark.parametrize("shape", [boosting.Shape(rounds=4, depth=3, rate=0.3, bins=8), boosting.Shape(rounds=12, depth=1, rate=0.5, bins=5, l2=0.1)])
def test_boosting_against_plain_version(table, shape):
    x, y, rows = table
    model = boosting.fit(rows.repartition(5), list("abcd"), shape=shape)
    for j, c in enumerate(model.cuts):
        want = np.quantile(x[:, j][~np.isnan(x[:, j])], [i / shape.bins for i in range(1, shape.bins)])
        assert c == pytest.approx(sorted(set(want)))
    got = sorted(model.predict(rows).select("id", "predicted", "probability").collect())
    labels, p = plain_boosting(x, y, model.cuts, shape)
    assert np.allclose([r.probability for r in got], p, atol=1e-5)
    assert [r.predicted for r in got] == labels.tolist() and np.mean(labels == y) > 0.7
    again = boosting.fit(rows.repartition(2, "a"), list("abcd"), shape=shape)
    assert again.to_json() == model.to_json()  # however rows are dealt
    assert boosting.Boosted.from_json(model.to_json()).to_json() == model.to_json()


def test_boosting_on_odd_rows(spark, table, tmp_path):
    _, _, rows = table
    odd = rows.withColumns({"const": F.lit(1.0), "none": F.lit(None).cast("double"), "predicted": F.lit("own")})
    shape = boosting.Shape(rounds=2, depth=2, rows_share=0.5, columns_share=0.5)
    model = boosting.fit(odd.withColumn("label", F.when(F.col("id") > 3, F.col("label"))), ["const", "none", "a"], shape=shape)
    assert model.classes == [-1, 0, 1] and model.predict(odd).where("predicted in (-1, 0, 1)").count() == 260
    model.save(spark, f"file://{tmp_path}/m")
    assert boosting.Boosted.load(spark, f"file://{tmp_path}/m").to_json() == model.to_json()
    assert model.predict(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no labelled rows"):
        boosting.fit(odd.limit(0), ["a"])
    one = boosting.fit(odd.where("label = 1"), ["a"], shape=shape)
    assert one.classes == [1] and one.predict(odd).where("predicted = 1").count() == 260


def test_search_is_reproducible_and_finds_the_top(spark):
    space = {"x": search.Range(-3, 3), "n": search.Range(1, 40, whole=True), "r": search.Range(0.01, 1.0, log=True)}
    score = lambda p: -((p["x"] - 1) ** 2) - (p["n"] - 12) ** 2 / 100 - math.log(p["r"] / 0.1) ** 2
    one = search.search(spark, space, score, trials=40, first=8, side_by_side=3, seed=1)
    two = search.search(spark, space, score, trials=40, first=8, side_by_side=3, seed=1)
    assert one == two and [t.number for t in one] == list(range(40)) and one != search.search(spark, space, score, trials=40, first=8, side_by_side=3, seed=2)
    assert all(-3 <= t.parameters["x"] <= 3 and isinstance(t.parameters["n"], int) and 0.01 <= t.parameters["r"] <= 1 for t in one)
    later, early = [t.score for t in one[20:]], [t.score for t in one[:8]]
    assert np.mean(later) > np.mean(early) and search.best(one).score == max(t.score for t in one) > -0.5
    # the proposal spelled out: the draw with the greatest ratio of densities
    rng, again = np.random.default_rng(4), np.random.default_rng(4)
    places = search.propose(one[:9], {"x": space["x"]}, rng)
    ranked = sorted(one[:9], key=lambda t: -t.score)
    good, rest = [t.places["x"] for t in ranked[:3]], [t.places["x"] for t in ranked[3:]]
    centre, noise, flat = again.integers(0, 4, 24), None, None
    noise, flat = again.normal(0, 0.25, 24), again.random(24)
    draws = [flat[i] if c == 3 else min(max(good[c] + noise[i], 0), 1) for i, c in enumerate(centre)]
    kernel = lambda v, ps, w: (1 + sum(math.exp(-0.5 * ((v - p) / w) ** 2) / (w * math.sqrt(2 * math.pi)) for p in ps)) / (len(ps) + 1)
    assert places["x"] == pytest.approx(max(draws, key=lambda v: kernel(v, good, 0.25) / kernel(v, rest, 1 / 7)))


def test_tuned_trees(table):
    _, _, rows = table
    space = {"rounds": search.Range(1, 3, whole=True), "rate": search.Range(0.1, 0.5)}
    model, trials = L.tuned(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), list("abcd"), space=space, trials=3)
    top = search.best(trials)
    right = model.predict(rows.where("id % 3 = 0")).where("predicted = label").count() / 87
    assert len(trials) == 3 and top.score == pytest.approx(right) and model.shape.rounds == top.parameters["rounds"]


@pytest.mark.parametrize("name", ["model_logistic", "model_forest", "model_boosted"])
def test_models_predict(spark, name):
    """The join of features and labels ends, and every row of a test fold has a prediction."""
    rows = registry.queries()[name](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 50 and {r.predicted for r in rows} <= {-1, 0, 1} and len({(r.bar_no, r.fold) for r in rows}) == len(rows)


def test_search_query(spark):
    rows = registry.queries()["search_trials"](spark, "/root/testdata/sf0.01").collect()
    assert {r.trial for r in rows} == set(range(6)) and {r.parameter for r in rows} == set(more_queries.SEARCHED) and all(0 <= r.score <= 1 for r in rows)


# ---- cache and sweep ----


def test_cache_keeps_kinds_apart_and_makes_changed_days_anew(spark, tmp_path):
    ticks, root = B.event_ticks(spark, SF), f"file://{tmp_path}/cache"
    plain, volume, far = bar_cache.Key("tick", 20), bar_cache.Key("volume", 20), bar_cache.Key("tick", 20, filter="range 1/2", start="2024-01-05 00:00:00")
    for key, make in ((plain, B.tick_bars), (volume, B.volume_bars), (far, B.tick_bars)):
        assert bar_cache.read(spark, root, key) is None
        plan = bar_cache.refresh(ticks, root, key, lambda rows, make=make: make(rows, 20))
        assert {r.action for r in plan.collect()} == {"made"}
    assert len(bar_cache.keys(spark, root)) == 3
    counts = lambda key: bar_cache.read(spark, root, key).count()
    assert counts(plain) == B.tick_bars(ticks, 20).count() and counts(volume) == B.volume_bars(ticks, 20).count() and 0 < counts(far) < counts(plain)
    days = sorted(r.trade_date for r in ticks.select("trade_date").distinct().collect())
    changed = ticks.where(F.col("trade_date") != days[2]).withColumn("price", F.when(F.col("trade_date") == days[1], F.col("price") + 1).otherwise(F.col("price")))
    asked = []

    def make(rows):
        asked.extend(r.trade_date for r in rows.select("trade_date").distinct().collect())
        return B.tick_bars(rows, 20)

    plan = {r.day: r.action for r in bar_cache.refresh(changed, root, plain, make).collect()}
    assert asked == [days[1]] and plan[str(days[1])] == "made" and plan[str(days[2])] == "dropped" and list(plan.values()).count("kept") == len(days) - 2
    got, want = bar_cache.read(spark, root, plain), B.tick_bars(changed, 20)
    pick = lambda df: sorted(map(tuple, df.select("trade_date", "bar_idx", "open", "close", "tick_count").collect()))
    assert pick(got) == pick(want) and counts(volume) == B.volume_bars(ticks, 20).count()
    part = bar_cache.read(spark, root, plain, ["open_time"], f"{days[3]} 12:00:00", f"{days[4]} 12:00:00")
    assert part.columns == ["open_time"] and {r.open_time.date() for r in part.collect()} <= set(days[3:5])
    assert {r.action for r in bar_cache.refresh(changed, root, plain, make).collect()} == {"kept"}
    assert {r.action for r in bar_cache.refresh(ticks.limit(0), root, plain, make).collect()} == {"dropped"} and bar_cache.read(spark, root, plain) is None
    assert bar_cache.clear(spark, root) >= 2 and bar_cache.clear(spark, root) == 0


def test_sizes_of_the_two_looks():
    """The configurations that the sizes are meant for."""
    assert len(B.full_sizes(100, 1000, 10)) == 91 and len(B.full_sizes(200, 5000, 100)) == 49
    coarse = B.coarse_sizes(100, 1000, 100)
    assert coarse == list(range(100, 1001, 100)) and B.coarse_sizes(10, 35, 10) == [10, 20, 30, 35] and B.coarse_sizes(5, 7, 0) == [5, 6, 7]
    assert B.fine_sizes([100, 1000], 20, 10, 100, 1000) == [100, 110, 120, 980, 990, 1000]


@pytest.mark.parametrize("start, end, coarse, fine, reach", [(16, 80, 16, 8, 16), (15, 60, 15, 5, 10)])
def test_sweep_with_and_without_units(spark, start, end, coarse, fine, reach):
    ticks = B.event_ticks(spark, SF)

    def score(bars):
        """Best are sizes near 41, whatever the bars."""
        rows = bars.groupBy("symbol", "bar_size").agg(F.count("*").alias("bars"), F.sum("tick_count").alias("trades"))
        return rows.select("bar_size", F.lit("m").alias("model"), (-F.abs(F.col("bar_size") - 41.0)).alias("sharpe"), F.lit(1.0).alias("mdd_pct"), F.lit(50.0).alias("win_rate"), F.lit(0.0).alias("return_pct"), "trades")

    got = {r.bar_size: r for r in sweep.coarse_to_fine(ticks, score, start, end, coarse, fine, reach).collect()}
    first = set(B.coarse_sizes(start, end, coarse))
    centre = min(sorted(first), key=lambda s: abs(s - 41))
    assert {s for s, r in got.items() if r.stage == 1} == first
    assert set(got) == first | set(B.fine_sizes([centre], reach, fine, start, end))
    assert {r.trades for r in got.values()} == {ticks.count()}  # no tick is lost on the way through the units
    assert [s for s, r in got.items() if r.is_chosen] == [min(sorted(got), key=lambda s: abs(s - 41))]
    assert sweep.coarse_to_fine(ticks.limit(0), score, start, end, coarse, fine, reach).count() == 0
    with pytest.raises(ValueError, match="0 < start"):
        sweep.coarse_to_fine(ticks, score, 50, 10, 5, 5, 5)
