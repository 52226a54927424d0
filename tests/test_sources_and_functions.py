"""The CDT data source, and indicators with parameters as columns and from SQL."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_recurrences import walk

from tidemill.functions import indicators, parametric, windows
from tidemill.sources import cdt

# ---- CDT ----


def bars_of(spark, n, symbols="ab"):
    rows = [(s, i, float(i), i * 2.0, 1.5, 2.5, 10 + i) for s in symbols for i in range(n)]
    rows = spark.createDataFrame(rows, "symbol string, i int, open double, high double, low double, close double, volume bigint")
    return rows.withColumn("open_time", F.timestamp_seconds(F.lit(1704186000) + F.col("i")).cast("timestamp_ntz"))


def test_round_trip_in_stretches(spark, tmp_path):
    path, bars = f"file://{tmp_path}/with space/x", bars_of(spark, 1000)
    done = sorted(map(tuple, cdt.write(bars.repartition(5), "symbol", path).collect()))
    assert done == [("a", "a.cdt", 1000), ("b", "b.cdt", 1000)]
    folder = tmp_path / "with space" / "x"
    assert sorted(f.name for f in folder.iterdir()) == ["a.cdt", "b.cdt"] and (folder / "a.cdt").stat().st_size == 8 + 64_000
    for stretch in (1_000_000, 64, 7):
        back = cdt.read(spark, path, stretch)
        got = [(r.file, r.timestamp, r.open, r.volume, r.trading_value) for r in back.orderBy("file", "timestamp").collect()]
        assert [g[2:] for g in got] == [(float(i), 10.0 + i, 2.5 * (10 + i)) for i in range(1000)] * 2
        assert got[0][:2] == ("a.cdt", "2024-01-02 09:00:00") and got[1001][:2] == ("b.cdt", "2024-01-02 09:00:01")
    raw = spark.read.format("cdt").option("stretch", 100).load(path)
    only = spark.read.format("cdt").option("stretch", 100).option("names", "b.cdt,x.cdt").load(path)
    assert only.count() == 1000 and only.rdd.getNumPartitions() == 10 and raw.rdd.getNumPartitions() == 20
    assert raw.where("file = 'b.cdt'").count() == 1000 and raw.count() == 2000
    assert raw.where("file in ('a.cdt', 'c.cdt') and close > 100").count() == 0 and raw.where("file = 'c.cdt'").count() == 0
    # other files stay, files of the same name give way
    cdt.write(bars_of(spark, 3, "bc"), "symbol", path)
    assert {r.file: r["count"] for r in cdt.read(spark, path).groupBy("file").count().collect()} == {"a.cdt": 1000, "b.cdt": 3, "c.cdt": 3}
    cdt.write(bars.limit(0), "symbol", path)
    assert cdt.read(spark, path).count() == 1006
    rows = bars_of(spark, 2, "z").select(F.lit("z.cdt").alias("file"), *[F.lit(1.0).alias(f) for f in cdt.FIELDS], F.lit(2).cast("bigint").alias("records"))
    rows.coalesce(1).write.format("cdt").mode("overwrite").save(path)
    assert [f.name for f in folder.iterdir()] == ["z.cdt"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    cdt.register(spark)
    path = f"file://{tmp_path}/x"
    cells = [F.col("id").cast("double").alias(f) for f in cdt.FIELDS]
    apart = spark.range(4).select(F.when(F.col("id") % 2 == 0, "a.cdt").otherwise("b.cdt").alias("file"), *cells, F.lit(2).cast("bigint").alias("records"))
    with pytest.raises(Exception, match="not together"):
        apart.coalesce(1).write.format("cdt").mode("append").save(path)
    with pytest.raises(Exception, match="several partitions"):
        apart.withColumn("file", F.lit("a.cdt")).repartition(4, "stamp").write.format("cdt").mode("append").save(path)
    assert not any(f.suffix == ".cdt" for f in tmp_path.rglob("*"))


def test_other_widths_and_broken_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    wide = np.arange(20, dtype="<f8").reshape(2, 10)
    (tmp_path / "sub" / "w.cdt").write_bytes(struct.pack("<2i", 3, 2) + wide.tobytes())
    (tmp_path / "short.cdt").write_bytes(b"1234")
    (tmp_path / "none.cdt").write_bytes(struct.pack("<2i", 1, 0))
    (tmp_path / "cut.cdt").write_bytes(struct.pack("<2i", 1, 5) + np.arange(17, dtype="<f8").tobytes())
    (tmp_path / "note.txt").write_bytes(b"x" * 100)
    got = {}
    for r in cdt.read(spark, f"file://{tmp_path}", 1).collect():
        got.setdefault(r.file, []).append(r.open)
    assert got == {"w.cdt": [1.0, 11.0], "cut.cdt": [1.0, 9.0]}
    assert cdt.read(spark, f"file://{tmp_path}/sub/w.cdt").count() == 2
    (tmp_path / "empty").mkdir()
    assert cdt.read(spark, f"file://{tmp_path}/empty").count() == 0


# ---- indicators ----

ODD = {"sma": {"n": 5}, "ema": {"n": 6}, "rsi": {"n": 7}, "atr": {"n": 3}, "macd": {"fast": 4, "slow": 9, "signal": 3}, "bollinger": {"n": 6, "k": 1.5}, "donchian": {"n": 4}, "roc": {"n": 3}, "williams_r": {"n": 5}, "supertrend": {"n": 7, "m": 2.0}}


@pytest.fixture(scope="module")
def bars(spark):
    a, b = walk(90, 11), walk(40, 12)
    b["symbol"] = "y"
    rows = [*a.itertuples(index=False), *b.itertuples(index=False)]
    return spark.createDataFrame(rows, list(a.columns))


@pytest.mark.parametrize("name", sorted(parametric.SPECS))
def test_columns_and_sql_agree(spark, bars, name):
    """Windows over chunks and the machine that goes bar by bar, which share no step."""
    assert set(ODD) == set(parametric.SPECS)
    outs, p = parametric.SPECS[name].outputs, ODD[name]
    want = sorted(map(tuple, parametric.with_indicator(bars, name, **p).select("symbol", "bar_no", *outs).collect()))
    parametric.register(spark)
    bars.createOrReplaceTempView("odd_bars")
    named = ", ".join(f"'{k}', CAST({v} AS DOUBLE)" for k, v in p.items())
    rows = spark.sql(f"SELECT * FROM indicator(TABLE(SELECT * FROM odd_bars) PARTITION BY symbol ORDER BY (bar_no), '{name}', map({named}))")
    assert rows.columns == [*bars.columns, *outs]
    got = sorted(map(tuple, rows.select("symbol", "bar_no", *outs).collect()))
    assert len(got) == len(want) == 130 and any(r[2] is not None for r in got)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and all((x is None and y is None) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(g[2:], w[2:])), (g, w)


def test_usual_parameters_are_the_fixed_indicators(spark, bars):
    for name, columns in (("rsi", ["rsi"]), ("bollinger", ["bb_mid", "bb_upper", "bb_lower"]), ("supertrend", ["supertrend", "supertrend_dir"]), ("macd", ["macd_hist"])):
        a, b = (sorted(map(tuple, df.select("symbol", "bar_no", *columns).collect())) for df in (parametric.with_indicator(bars, name), indicators.with_indicators(bars, columns)))
        assert all(x == y or np.allclose(np.array(x[2:], float), np.array(y[2:], float), equal_nan=True) for x, y in zip(a, b, strict=True)), name


def test_parametric_columns_in_small_chunks(spark, bars, monkeypatch):
    want = {n: sorted(map(tuple, parametric.with_indicator(bars, n, **ODD[n]).select("symbol", "bar_no", *parametric.SPECS[n].outputs).collect())) for n in ("donchian", "roc")}
    monkeypatch.setattr(windows, "CHUNK", 16)
    for n, rows in want.items():
        assert sorted(map(tuple, parametric.with_indicator(bars, n, **ODD[n]).select("symbol", "bar_no", *parametric.SPECS[n].outputs).collect())) == rows


def test_wrong_parameters(spark, bars):
    for name, p, said in (("nothing", {}, "no indicator"), ("rsi", {"k": 1}, "no parameter"), ("rsi", {"n": 1}, "whole number"), ("sma", {"n": 2.5}, "whole number")):
        with pytest.raises(ValueError, match=said):
            parametric.with_indicator(bars, name, **p)
    parametric.register(spark)
    bars.createOrReplaceTempView("odd_bars")
    with pytest.raises(Exception, match="no indicator"):
        spark.sql("SELECT * FROM indicator(TABLE(SELECT * FROM odd_bars) PARTITION BY symbol ORDER BY (bar_no), 'nothing')").collect()
    missing = bars.withColumn("close", F.when(F.col("bar_no") != 5, F.col("close")))
    missing.createOrReplaceTempView("odd_bars")
    rows = spark.sql("SELECT * FROM indicator(TABLE(SELECT * FROM odd_bars) PARTITION BY symbol ORDER BY (bar_no), 'rsi')")
    assert rows.where("bar_no = 5 and rsi is null").count() == 2 and rows.where("rsi is null").count() == 2


def test_csv_files_are_read_in_pieces(spark, tmp_path):
    """A file of many lines comes some thousand at a time, in the encoding of the whole file, whatever its name."""
    import pandas as pd

    from tidemill.sources import csv_ticks

    lines = [f"2024-01-02 09:{i // 60 % 60:02d}:{i % 60:02d},{i},{i % 9},x" for i in range(60_000)] + ["2024-01-02 10:00:00,7,1,가나다€"]
    path = tmp_path / "a%20b?c#.csv"
    path.write_bytes(("time,price,volume,side\n" + "\n".join(lines) + "\n").encode())
    frames = list(csv_ticks._lines(iter([pd.DataFrame({"path": [f"file:{path}"]})])))
    assert len(frames) == 7 and max(map(len, frames)) == csv_ticks.LINES
    whole = pd.concat(frames, ignore_index=True)
    assert list(whole["line"]) == list(range(60_001)) and list(whole["price"][:-1]) == [str(i) for i in range(60_000)] and whole["side"].iloc[-1] == "가나다€"
    assert csv_ticks.read_ticks(spark, f"file://{tmp_path}").count() == 60_001
