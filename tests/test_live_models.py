"""Live bars whose size changes, their status, and live decisions of a saved model with a watch on drift."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemill.operators import bars as B
from tidemill.operators import boosting, model_versions
from tidemill.operators import learning as L
from tidemill.plans import stream_queries
from tidemill.sources.shared import shared_path
from tidemill.streaming import live, resizable


class Held:
    """A state variable in memory."""

    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return iter(list(self.x)) if isinstance(self.x, list) else self.x

    def update(self, x):
        self.x = x

    put = update

    def appendList(self, xs):  # noqa: N802
        self.x = [*(self.x or []), *xs]

    def clear(self):
        self.x = None


class Handle:
    getValueState = getListState = lambda self, *a: Held()  # noqa: N815


def plain_bars(ticks, size):
    out = []
    for i in range(0, len(ticks), size):
        p = [t[1] for t in ticks[i : i + size]]
        out.append((i // size, p[0], max(p), min(p), p[-1], sum(t[2] for t in ticks[i : i + size]), len(p), len(p) == size))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_sizes_change_at_any_tick(seed):
    """Batches of ticks and orders against one list of all that has come."""
    rng = np.random.default_rng(seed)
    keep, size, version, base, everything = 40, 7, 0, 0, []
    keeper, shown = resizable.Keeper(size, keep, True), {}
    keeper.init(Handle())
    at = 0
    for _ in range(25):
        rows = []
        for _ in range(rng.integers(1, 30)):
            at += 1
            if rng.random() < 0.03:
                rows.append((at, -(1 << 62), None, None, int(rng.integers(0, 12))))
                size, version = max(1, rows[-1][-1]), version + 1
                base = max(0, len(everything) - keep)
            else:
                rows.append((at, at, float(rng.integers(1, 50)), int(rng.integers(0, 9)), None))
                everything.append((at, *rows[-1][2:4]))
        rng.shuffle(rows)
        f = pd.DataFrame(rows, columns=["at", "seq", "price", "volume", "size"]).astype({"size": "float64"})
        for made in keeper.handleInputRows(("x",), iter([f.iloc[:5], f.iloc[5:]]), None):
            for r in made.itertuples(index=False):
                shown[r.version, r.bar_no] = (r.bar_no, r.open, r.high, r.low, r.close, r.volume, r.ticks, r.complete)
        now = [shown[k] for k in sorted(shown) if k[0] == version]
        assert now == plain_bars(everything[base:], size)
        assert len(list(keeper.ring.get() or [])) <= 2 * keep and keeper.now.get()[4] == len(everything)


@pytest.fixture(scope="module")
def in_files(spark, tmp_path_factory):
    """The events in six files in the order of time."""
    path = tmp_path_factory.mktemp("files")
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").toPandas()
    (path / "events.parquet").mkdir()
    for i in range(6):
        part = spark.createDataFrame(rows.iloc[len(rows) * i // 6 : len(rows) * (i + 1) // 6])
        part.coalesce(1).write.parquet(f"file://{path}/one-{i}")
        next((path / f"one-{i}").glob("*.parquet")).rename(path / "events.parquet" / f"part-{i:02d}.parquet")
    return f"file://{path}"


def test_change_over_triggers_and_status(spark, in_files):
    orders = spark.createDataFrame([("click", 11), ("view", 1), ("nothing", 3)], "symbol string, size int").withColumn("ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    path, marks = shared_path(spark, "orders"), shared_path(spark, "marks")
    orders.select("symbol", "ts", "size").write.parquet(path)
    with resizable.rocksdb(spark):
        stream = resizable.resizable_bars(live.tick_stream(spark, in_files, 1), spark.readStream.schema("symbol string, ts timestamp_ntz, size int").parquet(path), 7)
        bars = live.run_once(stream, "resized", "update", ["symbol", "version", "bar_no"], marks)
    got = resizable.last_version(bars).collect()
    ticks = B.event_ticks(spark, SF)
    columns = ["symbol", "bar_no", "open_time", "close_time", "open", "high", "low", "close", "volume", "ticks", "complete"]
    want = []
    for symbol in {r.symbol for r in ticks.select("symbol").distinct().collect()}:
        size = {"click": 11, "view": 1}.get(symbol, 7)
        want += live.rebuild(ticks.where(F.col("symbol") == symbol), size).select(*columns).collect()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got))) == sorted(map(str, map(tuple, want)))
    state = {r.symbol: r for r in resizable.status(spark, marks).collect()}
    for symbol, r in state.items():
        own = sorted(x for x in want if x.symbol == symbol and not x.complete)
        assert (r.size, r.version) == {"click": (11, 1), "view": (1, 1), "nothing": (3, 1)}.get(symbol, (7, 0))
        assert r.forming_ticks == (own[0].ticks if own else 0) and r.progress_pct == round(r.forming_ticks / r.size * 100, 1)
        if own:
            assert (r.open, r.high, r.low, r.close, r.volume) == (own[0].open, own[0].high, own[0].low, own[0].close, own[0].volume)
    assert state["nothing"].ticks == 0 and state["nothing"].price is None
    totals = {r.symbol: r["count"] for r in ticks.groupBy("symbol").count().collect()}
    assert {s: r.ticks for s, r in state.items() if s != "nothing"} == totals


def test_saved_model_decides_as_in_batch(spark, in_files):
    """A pinned version over six triggers, against features of all bars at once; counts of the triggers add up."""
    ticks = B.event_ticks(spark, SF)
    rows = live.rebuild(ticks, 4).where("complete").withColumns({"bar_size": F.lit(0), "datetime": F.col("close_time"), "tick_count": F.col("ticks")})
    # what the stream knows of a bar besides: money and the volume of rising ticks
    made = live.run_once(live.live_bars(live.tick_stream(spark, SF), 4), "bars")
    rows = rows.join(made.select("symbol", "bar_no", "money", "bought"), ["symbol", "bar_no"]).withColumns({
        "vwap": F.col("money") / F.greatest(F.lit(1), "volume"), "buy_ratio": F.col("bought") / F.greatest(F.lit(1), "volume"),
        "bar_duration_sec": F.greatest(F.lit(0.1), F.expr("timestampdiff(MICROSECOND, open_time, close_time)") / 1e6),
    })
    known = L.features(rows).withColumn("label", F.signum("ret_3").cast("int"))
    root = shared_path(spark, "models")
    old = boosting.fit(known, L.FEATURES, shape=boosting.Shape(rounds=1, depth=1))
    new = boosting.fit(known, L.FEATURES, shape=boosting.Shape(rounds=6, depth=3, rate=0.5))
    with pytest.raises(ValueError, match="no such version"):
        model_versions.load(spark, root)
    assert [model_versions.save(spark, root, m, known) for m in (old, new, old)] == [1, 2, 3]
    with pytest.raises(ValueError, match="no such version"):
        model_versions.load(spark, root, 9)
    model, expected, number = model_versions.load(spark, root, 2)
    assert model.to_json() == new.to_json() and number == 2 and model_versions.load(spark, root)[2] == 3
    path = shared_path(spark, "decisions")
    label = lambda f: model.predict(f).withColumnRenamed("predicted", "label")
    live.decide(live.live_bars(live.tick_stream(spark, in_files, 1), 4), path, label, warm=20, watch=lambda f: model_versions.counted(model, f)).awaitTermination()
    got = {(r.symbol, r.bar_no): r.label for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/decisions").collect()}
    batch = {(r.symbol, r.bar_no): r.predicted for r in model.predict(known).collect()}
    assert got == {k: batch.get(k, 0) for k in got} and len(got) == sum(r.bar_no >= 19 for r in rows.select("bar_no").collect()) and len(set(got.values())) == 3
    seen = spark.read.schema(model_versions.COUNTS).option("recursiveFileLookup", "true").parquet(f"{path}/drift")
    whole = lambda df: {(r[0], r[1]): r[2] for r in df.groupBy("column", "cell").agg(F.sum("n")).collect()}
    assert whole(seen) == whole(model_versions.counted(model, known)) and seen.count() > len(whole(seen))
    assert all(abs(r.psi) < 1e-12 for r in model_versions.psi(expected, seen).collect())
    # an index spelled out
    some = known.where("bar_no < 25")
    drifted = {r.feature: r.psi for r in model_versions.psi(expected, model_versions.counted(model, some)).collect()}
    e, a = whole(expected), whole(model_versions.counted(model, some))
    for c in model.columns:
        cells = {k[1] for k in (*e, *a) if k[0] == c}
        share = lambda n, k: max(n.get((c, k), 0) / sum(v for (x, _), v in n.items() if x == c), 1e-4)  # noqa: B023, E731
        assert drifted[c] == pytest.approx(sum((share(a, k) - share(e, k)) * np.log(share(a, k) / share(e, k)) for k in cells))


def test_stream_query_with_a_model(spark):
    got = stream_queries.stream_model_decisions(spark, "/root/testdata/sf0.01").collect()
    assert len(got) > 100 and {r.action for r in got} <= {"BUY", "SELL", "HOLD"} and min(r.bar_no for r in got) == 39
    psi = stream_queries.stream_drift(spark, "/root/testdata/sf0.01").collect()
    assert {r.feature for r in psi} == set(L.FEATURES) and all(r.psi >= 0 for r in psi)


@pytest.mark.parametrize("keep", [40, None])
def test_sizes_change_in_batch_plans(spark, tmp_path, keep):
    """Triggers as batch plans against one list of all that has come; no Python process gets a symbol's ticks."""
    rng, at, ticks, size, version, base, shown = np.random.default_rng(5), 0, [], 7, 0, 0, {}
    schema = "symbol string, ts timestamp_ntz, seq bigint, price double, volume bigint, size int"
    stream = None
    for number, orders in enumerate(([], [9, 21], [50, 4], [])):
        rows = []
        for i in range(30 + 20 * number):
            at += 1
            moment = (pd.Timestamp("2024-01-02") + pd.Timedelta(seconds=at * 7)).to_pydatetime()
            if i in orders:
                rows.append((None, moment, None, None, None, int(rng.integers(0, 12))))
                size, version, base = max(1, rows[-1][-1]), version + 1, max(0, len(ticks) - keep) if keep else 0
            else:
                rows.append((None, moment, at, float(rng.integers(1, 50)), int(rng.integers(0, 9)), None))
                ticks.append((at, *rows[-1][3:5]))
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, schema)
        stream = resizable.resizable_bars(df.where("size is null"), df.where("size is not null").select("symbol", "ts", "size"), 7, keep)
        made = stream.make(stream.source, number, f"file://{tmp_path}/held")
        assert not any(w in made._jdf.queryExecution().toString() for w in ("Pandas", "Python", "InArrow"))
        for r in made.collect():
            shown[r.version, r.bar_no] = (r.bar_no, r.open, r.high, r.low, r.close, r.volume, r.ticks, r.complete)
        assert [shown[k] for k in sorted(shown) if k[0] == version] == plain_bars(ticks[base:], size)
        now = resizable.status(spark, f"file://{tmp_path}").first()
        last = plain_bars(ticks[base:], size)[-1]
        assert (now.ticks, now.size, now.version, now.price) == (len(ticks), size, version, ticks[-1][1]) and now.forming_ticks == (0 if last[-1] else last[-2])
