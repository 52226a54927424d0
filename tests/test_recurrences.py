"""State machines against plain loops, properties of bars, and what SQL can't express."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import indicators, strategies, windows
from tidemill.functions.windows import rolling_median, series
from tidemill.operators import bars as B
from tidemill.operators import learning as L
from tidemill.operators import quality as Q
from tidemill.sources import cdt, csv_ticks


def walk(n=400, seed=1):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n)).round(2)
    open_ = np.concatenate(([close[0]], close[:-1])) + rng.normal(0, 0.2, n).round(2)
    high, low = np.maximum(open_, close) + rng.random(n).round(2), np.minimum(open_, close) - rng.random(n).round(2)
    return pd.DataFrame({"symbol": "x", "bar_size": 20, "bar_no": range(n), "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 99, n), "vwap": close})


def test_parabolic_rises_and_flips():
    f = walk()
    high, low = f["high"].to_numpy(), f["low"].to_numpy()
    stop, side, _ = indicators.parabolic(high, low)
    half, _, state = indicators.parabolic(high[:150], low[:150])
    assert np.concatenate((half, indicators.parabolic(high[150:], low[150:], state)[0])).tolist() == stop.tolist()
    s, d, af, ep = low[0], 1, 0.02, high[0]
    for i in range(1, len(high)):  # the rule spelled out for either direction
        s = s + af * (ep - s)
        if d == 1:
            s = min(s, low[i - 1], low[max(i - 2, 0)])
            if low[i] < s:
                s, d, af, ep = ep, -1, 0.02, low[i]
            elif high[i] > ep:
                ep, af = high[i], min(af + 0.02, 0.2)
        else:
            s = max(s, high[i - 1], high[max(i - 2, 0)])
            if high[i] > s:
                s, d, af, ep = ep, 1, 0.02, high[i]
            elif low[i] < ep:
                ep, af = low[i], min(af + 0.02, 0.2)
        assert d == side[i] and math.isclose(s, stop[i], rel_tol=1e-12)
    assert set(side) == {1, -1}


def chunked(spark, f, monkeypatch, chunk):
    monkeypatch.setattr(windows, "CHUNK", chunk)
    bars = spark.createDataFrame(f)
    return bars.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in bars.dtypes if kind == "double"})


def test_exponential_means_are_those_of_a_plain_recursion(spark, monkeypatch):
    f = walk(9000, 3)[["symbol", "bar_size", "bar_no", "close"]]
    f["late"] = f["close"].where(f["bar_no"] >= 7)
    f["gaps"] = f["close"].where((f["bar_no"] % 5 != 0) & ~f["bar_no"].between(4000, 4300) & (f["bar_no"] > 3)).sub(100)
    by, book = ["symbol", "bar_size"], {}
    for name, x, how in (("a", "close", {"span": 100}), ("b", "late", {"span": 7}), ("c", "gaps", {"alpha": 1 / 14, "gaps": True}), ("d", "a", {"span": 9})):
        book |= windows.ewm_steps(name, x, by, **how)
    rows = windows.in_chunks(chunked(spark, f, monkeypatch, 4096), by, windows.WARM)
    got = windows.own_rows(windows.with_needed(rows, list("abcd"), book)).select("bar_no", *"abcd").toPandas().sort_values("bar_no")
    mean = lambda x, **how: x.ewm(adjust=False, **how).mean()
    want = {"a": mean(f["close"], span=100), "b": mean(f["late"], span=7), "c": mean(f["gaps"], alpha=1 / 14)}
    want["d"] = mean(want["a"], span=9)
    assert len(got) == len(f)
    for k, x in want.items():
        np.testing.assert_allclose(got[k].to_numpy(), x.to_numpy(), rtol=1e-10, atol=1e-10, err_msg=k)
    with pytest.raises(ValueError):
        windows.ewm_steps("e", "close", by, alpha=0.9)


def test_chunks_change_nothing(spark, monkeypatch):
    """A series in several chunks and in one, for two symbols one of which has no name."""
    f = pd.concat([walk(5000, 4).assign(symbol="a"), walk(300, 6).assign(symbol=None)])
    columns = " ".join(indicators.INDICATORS[k] for k in ("macd", "ichimoku", "supertrend", "adx_di", "psar", "trix", "rvi", "ulcer", "candles")).split()
    names = ["Donchian_Channel", "Contrarian_BB_Consecutive", "Genius_NQ_Adaptive_Ribbon", "Ulcer_Index"]
    keys = ["symbol", "bar_no"]
    made = []
    for chunk in (4096, 1 << 20):
        bars = chunked(spark, f, monkeypatch, chunk)
        a = indicators.with_indicators(bars, columns).select(*keys, *columns).toPandas().sort_values(keys).reset_index(drop=True)
        made.append((a, strategies.with_signals(bars, names).select(*keys, *names).toPandas().sort_values(keys).reset_index(drop=True)))
    (a, s), (b, t) = made
    assert len(a) == len(s) == len(f)
    for c in columns:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-8, atol=1e-8, err_msg=c)
    assert (s[names] == t[names]).all().all()


def test_native_indicators_need_no_python(spark):
    for columns in (["bb_pct_b"], ["roc"], ["donchian_mid"], ["macd_hist"], ["adx"], ["rvi"]):
        plan = indicators.with_indicators(spark.createDataFrame(walk()), columns)._jdf.queryExecution().optimizedPlan().toString()
        assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan, columns


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    f = pd.concat([pd.DataFrame({"k": "a", "x": rng.lognormal(0, 3, 2001)}), pd.DataFrame({"k": "b", "x": rng.integers(0, 5, 500) * 1.0}), pd.DataFrame({"k": "c", "x": [7.0]}), pd.DataFrame({"k": "d", "x": [np.nan]})])
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.n, r.quantiles) for r in windows.quantiles(spark.createDataFrame(f), ["k"], "x", at, cells=16).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, (n, q) in got.items():
        x = f.loc[f["k"] == k, "x"]
        assert n == len(x)
        np.testing.assert_allclose(q, x.quantile(at).to_numpy(), rtol=1e-12)


def test_lagged_crosses_pieces(spark):
    rows = spark.createDataFrame([(d, i, float(i * i)) for d in (1, 2) for i in range(40)], "d int, i int, x double")
    got = windows.lagged(rows, ["d"], F.expr("i div 7"), ["i"], {"p": "x"}).collect()
    assert len(got) == 80 and all(r.p == (None if r.i == 0 else float((r.i - 1) ** 2)) for r in got)


def test_day_median_leaves_out_ticks_without_price_or_with_negative_volume(spark):
    rows = [("2024-01-02", float(p), v) for p, v in [(100, 1), (101, 1), (102, 1), (0, 5), (0, 5), (-3, 1), (900, -1), (901, -2)]]
    ticks = spark.createDataFrame(rows, "trade_date string, price double, volume bigint").withColumn("ts", F.lit("2024-01-02 10:00:00").cast("timestamp_ntz")).withColumn("seq", F.monotonically_increasing_id())
    assert B.day_stats(ticks).first().day_median == 101.0
    assert sorted(r.price for r in B.median_filter(ticks).collect()) == [100.0, 101.0, 102.0]
    counted = B.count_outliers(ticks).first()
    assert (counted.total_ticks, counted.outliers) == (8, 5)


def test_contrarian_holds_and_turns():
    close, mid = np.array([10, 12, 12, 12, 12, 9, 9.0]), np.array([10.0] * 7)
    short, long = np.array([0, 1, 0, 0, 0, 0, 0], bool), np.zeros(7, bool)
    assert strategies.contrarian(close, mid, short, long, 5)[0].tolist() == [0, -1, -1, -1, -1, 0, 0]
    assert strategies.contrarian(close, mid, short, long, 2)[0].tolist() == [0, -1, -1, 0, 0, 0, 0]
    turn = np.array([0, 0, 1, 0, 0, 0, 0], bool)
    assert strategies.contrarian(close, mid, short, turn, 5)[0].tolist() == [0, -1, 1, 0, 0, 0, 0]
    assert [strategies.hold(n) for n in (20, 10_000, 10_001, 30_000)] == [5, 5, 3, 2]


def test_breakout_enters_adds_and_stops(spark):
    names = strategies.TREND[:3]
    f = strategies.with_signals(spark.createDataFrame(walk(600, 5)), names).toPandas().sort_values("bar_no")
    added, plain = f[names[0]].to_numpy(), f[names[1]].to_numpy()
    assert set(plain) <= {-1, 0, 1} and set(added) <= {-2, -1, 0, 1, 2} and (plain[:25] == 0).all()
    assert np.abs(plain).sum() > 0 and np.abs(added).max() == 2


def test_all_strategies_have_a_signal(spark):
    rows = strategies.with_signals(spark.createDataFrame(walk()))
    got = rows.select("bar_no", *strategies.CATEGORIES["ALL"]).toPandas()
    assert len(got) == 400 and not got.isna().any().any()
    assert len(strategies.CATEGORIES["ALL"]) == 38
    with pytest.raises(ValueError):
        strategies.canonical("nothing")
    assert strategies.canonical("rsi") == "RSI"


def test_rolling_pieces(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, None), (3, 9.0)], "bar_no int, x double").withColumn("symbol", F.lit("a")).withColumn("bar_size", F.lit(1))
    got = rows.select("bar_no", rolling_median(F.col("x"), 3, series()).alias("m")).orderBy("bar_no").collect()
    assert [x.m for x in got] == [1.0, 3.0, 3.0, 7.0]


def test_sizes():
    assert len(B.full_sizes(100, 1000, 10)) == 91 and len(B.full_sizes(200, 5000, 100)) == 49 and len(B.sweep_sizes(100, 1000, 100)) == 10
    assert B.sweep_sizes(1000, 95, 400) == [95, 495, 895, 1000] and B.sweep_sizes(5, 5, 0) == [10]
    assert B.fine_sizes([100], 20, 10, 90, 1000) == [90, 100, 110, 120]
    with pytest.raises(ValueError):
        B.full_sizes(0, 10, 1)


def test_sweep_equals_single_sizes_and_unit_volume_bars_equal_tick_bars(spark):
    from conftest import SF

    ticks = B.event_ticks(spark, SF).withColumn("volume", F.lit(1).cast("bigint"))
    own = B.event_ticks(spark, SF).withColumn("bid", F.col("price"))
    whole, plain = B.tick_bars(own, [10, 20, 50]), B.tick_bars(own, 20).withColumn("vwap", F.round("vwap", 9))  # from bars of 10
    assert whole.where("bar_size = 20").withColumn("vwap", F.round("vwap", 9)).exceptAll(plain).count() == 0 and whole.where("bar_size = 20").count() == plain.count()
    sweep = B.tick_bars(ticks, [7, 13])
    for n in (7, 13):
        one = B.tick_bars(ticks, n)
        assert sweep.where(F.col("bar_size") == n).exceptAll(one).count() == 0 == one.exceptAll(sweep.where(F.col("bar_size") == n)).count()
    assert B.volume_bars(ticks, 7).exceptAll(B.tick_bars(ticks, 7)).count() == 0


def test_period_bounds():
    assert Q.period_bounds("MONTH", "2024-02") == ("2024-02-01 00:00:00", "2024-02-29 23:59:59")
    assert Q.period_bounds("ALL", "") == (None, None)


def test_csv_forms(spark, tmp_path):
    (tmp_path / "170328.csv").write_bytes("체결시간,현재가,체결량\n15:45:00,\"1,200.5\",3\n9:00:00,-1199,\n".encode("cp949"))
    (tmp_path / "ticks_20170329.csv").write_text("0,90000,x,x,x,101.5,x,x,7" + ",x" * 11 + "\n")
    (tmp_path / "short.csv").write_text("2017-03-30 10:00:01,55,9\n2017/03/30 10:00:02,56,8\n")
    (tmp_path / "empty.csv").write_text("")
    rows = csv_ticks.read_ticks(spark, f"file://{tmp_path}").orderBy("ts").collect()
    assert [(str(r.ts), r.price, r.volume) for r in rows] == [
        ("2017-03-28 09:00:00", 1199.0, 1), ("2017-03-28 15:45:00", 1200.5, 3), ("2017-03-29 09:00:00", 101.5, 7), ("2017-03-30 10:00:01", 55.0, 9), ("2017-03-30 10:00:02", 56.0, 8),
    ]


def test_scan_counts_bad_times_and_reversed_files(spark, tmp_path):
    (tmp_path / "170328.csv").write_text("time,price,volume\n15:45:00,10,1\nlate,11,1\n9:00:00,x,2\n")
    (tmp_path / "170329.CSV").write_text("time,price,volume\n090000,10,1\n2017-03-29 10:00:00,11,1\n")
    (tmp_path / "empty.csv").write_text("")
    got = {r.file: r[1:] for r in csv_ticks.scan_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"170328.csv": (3, 1, 1, True), "170329.CSV": (2, 0, 0, False)}


def test_sync_loads_new_and_changed_files(spark, tmp_path):
    src, table, manifest = tmp_path / "in", f"file://{tmp_path}/t", f"file://{tmp_path}/m"
    src.mkdir()
    (src / "20240102.csv").write_text("time,price,volume\n09:00:00,10,1\n")
    csv_ticks.sync(spark, f"file://{src}", table, manifest)
    (src / "20240103.csv").write_text("time,price,volume\n09:00:00,11,1\n09:00:01,12,1\n")
    (src / "20240102.csv").write_text("time,price,volume\n09:00:00,99,1\n")
    known = csv_ticks.read_manifest(spark, manifest)
    assert csv_ticks.to_sync(csv_ticks.listed(spark, f"file://{src}"), known).count() == 2
    csv_ticks.sync(spark, f"file://{src}", table, manifest)
    assert sorted(r.price for r in spark.read.parquet(table).collect()) == [11.0, 12.0, 99.0]
    assert csv_ticks.to_sync(csv_ticks.listed(spark, f"file://{src}"), csv_ticks.read_manifest(spark, manifest)).count() == 0
    assert csv_ticks.sync_status(spark, table, manifest).first().asDict() == {"total_files": 2, "total_ticks": 3}
    suspects = spark.createDataFrame([("20240103.csv",)], "file_name string")
    assert [r.file_name for r in csv_ticks.to_sync(csv_ticks.listed(spark, f"file://{src}/20240102.csv;file://{src}/20240103.csv"), csv_ticks.read_manifest(spark, manifest), suspects).collect()] == ["20240103.csv"]
    (src / "20240102.csv").unlink()
    csv_ticks.sync(spark, f"file://{src}", table, manifest, full=True)
    assert csv_ticks.sync_status(spark, table, manifest).first().total_files == 1 and spark.read.parquet(table).count() == 2


def test_cdt_widths():
    import struct

    rows = np.arange(30, dtype="<f8").reshape(3, 10)
    for kind, n in ((1, 8), (3, 10), (7, 10)):
        body = np.ascontiguousarray(rows[:, :n]).tobytes()
        got = cdt.parse(struct.pack("<2i", kind, 3) + body)
        assert got.to_numpy().tolist() == rows[:, :8].tolist()
    assert len(cdt.parse(b"")) == 0


def test_model_predictions(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    f = pd.DataFrame(x, columns=["a", "b", "c"]).assign(label=np.sign(x[:, 0]).astype(int), fold=0, part=["train"] * 200 + ["test"] * 100, bar_no=range(300))
    got = L.train_and_predict(spark.createDataFrame(f), ["a", "b", "c"], "logistic").toPandas()
    assert len(got) == 100 and (got["label"] == got["predicted"]).mean() > 0.9


def test_bar_csv_forms():
    head = cdt.parse_csv("timestamp,open,high,low,close,volume\n2024/01/02 09:00,1,\"1,002\",0.5,1.5,10\n")
    seven = cdt.parse_csv("20240102,93000,1,2,0.5,1.5,10\n")
    six = cdt.parse_csv("2024-01-02 09:30:00,1,2,0.5,1.5,10\n")
    assert head.iloc[0].tolist()[:6] == ["2024/01/02 09:00", 1.0, 1002.0, 0.5, 1.5, 10.0]
    assert seven.iloc[0, 0] == six.iloc[0, 0] == "2024-01-02 09:30:00" and seven.iloc[0, 1:6].tolist() == six.iloc[0, 1:6].tolist()
    assert len(cdt.parse_csv("")) == 0


def test_merge_keeps_one_of_like_bars_and_periods_select(spark):
    schema = "timestamp string, open double, high double, low double, close double, volume double"
    a = spark.createDataFrame([("2024/01/02 09:00", 1.0, 2.0, 0.5, 1.5, 10.0)], schema)
    b = spark.createDataFrame([("2024-01-02 09:00", 1.0, 2.0, 0.5, 1.5, 10.0), ("2024-02-01 09:00", 1.0, 2.0, 0.5, None, 0.0)], schema)
    got = {r.timestamp: r.vwap for r in Q.merge_bars([a, b]).collect()}
    assert got == {"2024-01-02 09:00": 1.5, "2024-02-01 09:00": 0.0}
    merged = Q.merge_bars([a, b])
    assert Q.in_period(merged, "timestamp", "MONTH", "2024-02").count() == 1 and Q.in_period(merged, "timestamp", "CUSTOM", "2024-01-01", "2024-01-31").count() == 1


def test_quotes_are_the_last_ones(spark):
    from conftest import SF

    ticks = B.event_ticks(spark, SF).withColumn("bid", F.col("price") - 1).withColumn("ask", F.col("price") + 1)
    assert B.tick_bars(ticks, 7).where((F.abs(F.col("bid") + 1 - F.col("close")) > 1e-9) | (F.abs(F.col("ask") - 1 - F.col("close")) > 1e-9)).count() == 0


def test_bar_cache_keeps_other_series(spark, tmp_path):
    from conftest import SF

    from tidemill.sources import bar_cache
    from tidemill.sources.bar_cache import Key

    root = f"file://{tmp_path}/bars"
    assert bar_cache.read(spark, root, Key("tick", 20)) is None and bar_cache.clear(spark, root) == 0
    bars = B.tick_bars(B.event_ticks(spark, SF), [20, 50], per_symbol=True)
    for symbol in ("click", "view"):
        for size in (20, 50):
            bar_cache.write(bars.where((F.col("symbol") == symbol) & (F.col("bar_size") == size)), root, Key("tick", size, symbol))
    some = bars.where("bar_size = 20 and symbol = 'click'")
    first = some.agg(F.min("trade_date")).first()[0]
    bar_cache.write(some.where(F.col("trade_date") == first).limit(1), root, Key("tick", 20, "click"))
    kept = some.where(F.col("trade_date") != first).count()
    assert bar_cache.read(spark, root, Key("tick", 20, "click")).count() == kept + 1
    assert bar_cache.read(spark, root, Key("tick", 50, "view")).count() == bars.where("bar_size = 50 and symbol = 'view'").count()
    assert bar_cache.read(spark, root, Key("tick", 50, "click"), ["close"]).columns == ["close"]
    assert bar_cache.clear(spark, root) == 4 and bar_cache.read(spark, root, Key("tick", 20, "click")) is None


def test_series_of_one_bar_have_zeros(spark):
    from tidemill.operators import backtest as T

    rows = spark.createDataFrame([("a", "s", 0, 10.0, 5, 1)], "symbol string, strategy string, bar_no bigint, close double, volume bigint, signal int").withColumn("open_time", F.lit("2024-01-02 10:00:00").cast("timestamp_ntz"))
    one = T.summary(T.equity(rows)).first().asDict()
    assert all(one[k] == 0 for k in one if k not in ("symbol", "strategy", "bars")) and one["bars"] == 1
    one = T.return_backtest(rows).first().asDict()
    assert all(one[k] == 0 for k in one if k not in ("symbol", "strategy", "bars"))


def test_series_without_bars_have_zeros(spark):
    from tidemill.operators import backtest as T

    rows = spark.createDataFrame([("a", "s", i, 10.0 + i, 5, 1) for i in range(4)] + [(None, "s", i, 9.0 + i, 5, 1) for i in range(4)], "symbol string, strategy string, bar_no bigint, close double, volume bigint, signal int")
    done = T.summary(T.equity(rows.withColumn("open_time", F.expr("timestamp_ntz'2024-01-02 10:00:00' + make_dt_interval(0, 0, bar_no)"))))
    asked = spark.createDataFrame([("a", "s"), ("b", "s"), ("b", "s"), (None, "s"), (None, "t")], "symbol string, strategy string")
    got = {(r.symbol, r.strategy): r.asDict() for r in T.asked_series(done, asked).collect()}
    own = {(r.symbol, r.strategy): r.asDict() for r in done.collect()}
    assert set(got) == {("a", "s"), ("b", "s"), (None, "s"), (None, "t")} and got["a", "s"] == own["a", "s"] and own["a", "s"]["bars"] == 4
    for key in (("b", "s"), (None, "t")):
        assert all(v == 0 for k, v in got[key].items() if k not in ("symbol", "strategy"))
    assert got[None, "s"]["bars"] == own.get((None, "s"), {"bars": 0})["bars"]
    assert T.asked_series(done, asked.limit(0)).count() == 0 and T.asked_series(done.limit(0), asked).count() == 4


def test_whole_signals_keep_two_units_and_no_loss_means_one(spark):
    from tidemill.operators import backtest as T

    rows = spark.createDataFrame([("s", i, 100.0 + i, 5, 2) for i in range(4)], "strategy string, bar_no bigint, close double, volume bigint, signal int")
    got = T.return_backtest(rows, mode="none", rate=0.0).first()
    want = (1 + 2 / 100) * (1 + 2 / 101) * (1 + 2 / 102)
    assert got.profit_factor == 1.0 and math.isclose(got.return_pct, (want - 1) * 100) and got.trades == 1


def test_settings(tmp_path):
    import json

    from tidemill.operators import config

    good = {k: {} for k in config.REQUIRED} | {"tick_window": {"start": 1, "end": 2, "step": 1}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    got = config.load(tmp_path / "a.json", {"tick_window": {"end": 9}, "data_dir": None, "more": 1})
    assert got["tick_window"] == {"start": 1, "end": 9, "step": 1} and got["more"] == 1 and got["data_dir"] == {}
    (tmp_path / "b.json").write_text(json.dumps(good | {"tick_window": {"start": 1}}))
    with pytest.raises(ValueError):
        config.load(tmp_path / "b.json")
