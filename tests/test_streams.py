import pytest
from conftest import SF

from tidemill.plans import registry


@pytest.mark.parametrize("name", ["stream_live_bars", "stream_quotes", "stream_windows"])
def test_part_files_stream_as_one_file_does(spark, tmp_path, name):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(2).write.parquet(f"file://{tmp_path}/events.parquet")
    query = registry.queries()[name]
    want, got = query(spark, SF).collect(), query(spark, f"file://{tmp_path}").collect()
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_quotes_fold_frames_of_a_few_rows(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_id", "event_type", "value").toPandas()
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    got = {r.symbol: r for r in registry.queries()["stream_quotes"](spark, SF).collect()}
    spark.conf.set(key, old)
    for symbol, own in rows.sort_values(["ts", "event_id"]).groupby("event_type"):
        gone = (own["ts"].iloc[-1] - own["ts"].iloc[-200:].iloc[0]).total_seconds()
        assert got[symbol].ticks == len(own) and got[symbol].price == own["value"].iloc[-1]
        assert got[symbol].change == pytest.approx(own["value"].iloc[-1] - own["value"].iloc[0], abs=1e-5)
        assert got[symbol].tps == pytest.approx((min(200, len(own)) - 1) / gone, abs=1e-5)


def test_streams_carry_their_state_over_triggers(spark, tmp_path):
    """The ticks in six files of some days each, one a trigger, against all of them at once."""
    from pyspark.sql import functions as F

    from tidemill.plans import stream_queries
    from tidemill.streaming import live

    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").toPandas()
    (tmp_path / "events.parquet").mkdir()
    for i in range(6):
        part = rows.iloc[len(rows) * i // 6 : len(rows) * (i + 1) // 6]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/one")
    files = sorted((tmp_path / "one").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    for i, f in enumerate(files):
        f.rename(tmp_path / "events.parquet" / f"part-{i:02d}.parquet")
    ticks = lambda: live.tick_stream(spark, f"file://{tmp_path}", 1)
    bars = live.run_once(live.live_bars(ticks(), 7), "bars")
    want = live.rebuild(stream_queries.B.event_ticks(spark, SF), 7)
    columns = ["symbol", "bar_no", "open_time", "close_time", "open", "high", "low", "close", "volume", "ticks"]
    assert sorted(map(str, bars.select(*columns).collect())) == sorted(map(str, want.where("complete").select(*columns).collect()))
    shown = live.run_once(live.live_bars(ticks(), 7, forming=True), "forming", "update", ["symbol", "bar_no"])
    assert sorted(map(str, shown.select(*columns, "complete").collect())) == sorted(map(str, want.select(*columns, "complete").collect()))
    assert {r.symbol: r.ticks for r in live.run_once(live.quotes(ticks()), "quotes", "update", ["symbol"]).collect()} == rows.groupby("event_type").size().to_dict()
    made = []
    for stream in (ticks(), live.tick_stream(spark, SF)):
        path = f"file://{tmp_path}/decisions-{len(made)}"
        live.decide(live.live_bars(stream, 2), path, stream_queries.rule, warm=30, keep=60).awaitTermination()
        made.append(spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/decisions").withColumn("take_profit", F.round("take_profit", 6)).withColumn("stop_loss", F.round("stop_loss", 6)).drop("trigger"))
    assert made[0].count() > 50 and sorted(map(str, made[0].collect())) == sorted(map(str, made[1].collect()))


def test_decisions_where_closes_are_zero(spark, tmp_path):
    """A close of 0 leaves returns without a value: the bars that lack a feature have label 0, in the SQL too."""
    import duckdb
    import pandas as pd
    from test_against_sql import rows_of

    closes = [10.0 + (i * 7) % 11 for i in range(100)]
    closes[60] = closes[75] = 0.0
    rows = [(12 * i + j, pd.Timestamp("2024-01-02") + pd.Timedelta(seconds=12 * i + j), 1, "a", c + (11 - j) * 0.5, '{"k": 3}') for i, c in enumerate(closes) for j in range(12)]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got = registry.queries()["stream_decisions"](spark, f"file://{tmp_path}").toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(registry.oracles()["stream_decisions"]).df()
    assert len(got) == 51 and rows_of(got) == rows_of(want)
    labels = dict(zip(got["bar_no"], got["label"], strict=True))
    assert all(labels[i + k] == 0 for i in (60, 75) for k in (2, 4, 6, 11)) and set(labels.values()) == {-1, 0, 1}


def test_bars_of_a_trigger_hold_no_symbol_in_python(spark, tmp_path):
    """Two triggers as batch plans, with null symbols and times; no Python process gets a symbol's ticks."""
    from pyspark.sql import functions as F

    from tidemill.streaming import live

    rows = [("a" if i % 3 else None, None if i in (3, 37) else f"2024-01-02 00:0{i // 10}:{i % 10:02d}", i, float((i * 7) % 13), i % 5) for i in range(40)]
    ticks = spark.createDataFrame(rows, "symbol string, ts string, seq bigint, price double, volume bigint").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    bars = live.live_bars(ticks, 4, forming=True)
    made = [bars.make(ticks.where(keep), i, f"file://{tmp_path}/held") for i, keep in enumerate(("seq < 21", "seq >= 21"))]
    assert not any(w in m._jdf.queryExecution().toString() for m in made for w in ("Pandas", "Python", "InArrow"))
    got = {(r.symbol, r.bar_no): (r.open, r.high, r.low, r.close, r.volume, r.ticks, r.money, r.bought, r.complete) for m in made for r in m.collect()}
    want = {}
    for symbol in (None, "a"):
        own = [r for part in (rows[:21], rows[21:]) for r in sorted((r for r in part if r[0] == symbol), key=lambda r: (r[1] is None, r[1] or "", r[2]))]
        rose = [r[4] if i and r[3] > own[i - 1][3] else 0 for i, r in enumerate(own)]
        for i in range(0, len(own), 4):
            p, v = [r[3] for r in own[i : i + 4]], [r[4] for r in own[i : i + 4]]
            want[symbol, i // 4] = (p[0], max(p), min(p), p[-1], sum(v), len(p), sum(x * y for x, y in zip(p, v, strict=True)), sum(rose[i : i + 4]), len(p) == 4)
    assert got == want
