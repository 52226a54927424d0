"""Live bars whose size can change in mid-stream, and their status read from what the last trigger has left.

Ticks and orders to change the size come as one stream of events. An order makes all bars of a symbol's last ticks anew in
the new size, as a new version of its bars, and later ticks go on from there. ``resizable_bars`` makes a trigger's bars by a
batch plan over tables of the ticks; no task holds a symbol. ``Keeper`` does the same in a stateful operator, for streams
with small triggers: its state lives in RocksDB, and a trigger's ticks of a symbol are one task's.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.windows import numbered
from ..sources.shared import stored
from .live import FEW, Triggers

BARS = (
    "symbol string, version int, size int, bar_no bigint, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double, volume bigint, ticks int,"
    " complete boolean"
)
#: Micros since 1970, price, volume.
TICK = "t bigint, p double, v bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start within have their state in RocksDB, which lists in a state need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def events(ticks: DataFrame, orders: DataFrame) -> DataFrame:
    """Ticks and orders (symbol, ts, size) as one stream. An order stands before the ticks of its moment."""
    names = ["symbol", "at", "seq", "price", "volume", "size"]
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    none = lambda kind: F.lit(None).cast(kind)
    a = ticks.select("symbol", micros.alias("at"), F.col("seq").cast("bigint").alias("seq"), F.col("price").cast("double").alias("price"), F.col("volume").cast("bigint").alias("volume"), none("int").alias("size"))
    b = orders.select("symbol", micros.alias("at"), F.lit(-(1 << 62)).alias("seq"), none("double").alias("price"), none("bigint").alias("volume"), F.col("size").cast("int").alias("size"))
    return a.select(*names).unionByName(b.select(*names))


def bars_of(ticks: np.ndarray, size: int) -> pd.DataFrame:
    """Bars of ``size`` ticks (columns time, price, volume), the last one perhaps forming."""
    if not len(ticks):
        return pd.DataFrame()
    at = np.arange(0, len(ticks), size)
    end = np.minimum(at + size, len(ticks)) - 1
    t, p, v = ticks["t"], ticks["p"], ticks["v"]
    return pd.DataFrame({
        "open_time": t[at], "close_time": t[end], "open": p[at], "high": np.maximum.reduceat(p, at), "low": np.minimum.reduceat(p, at), "close": p[end],
        "volume": np.add.reduceat(v, at), "ticks": end - at + 1, "complete": end - at + 1 == size,
    })


KIND = np.dtype([("t", np.int64), ("p", float), ("v", np.int64)])


class Keeper(StatefulProcessor):
    """size: until an order comes; keep: ticks of a symbol that an order can make bars of."""

    def __init__(self, size: int, keep: int, forming: bool):
        self.size, self.keep, self.shows = size, keep, forming

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "size int, version int, bar_no bigint, held bigint, ticks bigint, price double")
        self.forming = handle.getListState("forming", TICK)
        self.ring = handle.getListState("ring", TICK)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        size, version, number, held, total, price = self.now.get() if self.now.exists() else (self.size, 0, 0, 0, 0, None)
        arrived = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        new = np.fromiter(zip(arrived["at"], arrived["price"].fillna(0), arrived["volume"].fillna(0).astype("int64"), strict=True), KIND, len(arrived))
        orders = np.flatnonzero(arrived["size"].notna().to_numpy())
        ticks = self._list(self.forming)
        begin, fresh = 0, np.empty(0, KIND)  # ticks of this trigger so far
        for at in [*orders, len(new)]:
            ticks, fresh = np.concatenate([ticks, new[begin:at]]), np.concatenate([fresh, new[begin:at]])
            begin = at + 1
            if at < len(new):
                yield from self._bars(key, version, size, number, ticks, False)
                size, version, number = max(1, int(arrived["size"].iloc[at])), version + 1, 0
                ticks = np.concatenate([self._list(self.ring), fresh])[-self.keep :]
        yield from self._bars(key, version, size, number, ticks, self.shows)
        whole = len(ticks) // size
        self._put(self.forming, ticks[whole * size :])
        held += len(fresh)
        if held > 2 * self.keep:  # now and then, so that a tick is moved about once
            ring = np.concatenate([self._list(self.ring), fresh])[-self.keep :]
            self._put(self.ring, ring)
            held = len(ring)
        elif len(fresh):
            self.ring.appendList([tuple(x) for x in fresh.tolist()])
        price = float(fresh["p"][-1]) if len(fresh) else price
        self.now.update((size, version, number + whole, held, total + len(fresh), price))

    def close(self) -> None:
        pass

    @staticmethod
    def _list(state) -> np.ndarray:
        return np.array([tuple(x) for x in state.get()] if state.exists() else [], KIND)

    @staticmethod
    def _put(state, ticks: np.ndarray) -> None:
        if len(ticks):
            state.put([tuple(x) for x in ticks.tolist()])
        else:
            state.clear()

    @staticmethod
    def _bars(key, version: int, size: int, number: int, ticks: np.ndarray, forming: bool) -> Iterator[pd.DataFrame]:
        made = bars_of(ticks, size)
        if len(made) and not forming:
            made = made[made["complete"]]
        if len(made):
            made = made.assign(symbol=key[0], version=version, size=size, bar_no=number + np.arange(len(made)))
            made[["open_time", "close_time"]] = made[["open_time", "close_time"]].apply(lambda c: pd.to_datetime(c, unit="us"))
            yield made[[c.split()[0] for c in BARS.split(", ")]]


def stateful_bars(ticks: DataFrame, orders: DataFrame, size: int, keep: int = 15_000, forming: bool = True) -> DataFrame:
    """``resizable_bars`` by the ``Keeper``; bound a trigger by the source and start it within ``rocksdb``."""
    return events(ticks, orders).groupBy("symbol").transformWithStateInPandas(Keeper(size, keep, forming), BARS, "Update", "None")


def _few(table: DataFrame) -> DataFrame:
    """A table with a row for each symbol or order, broadcast if it is small."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


NOW = "symbol string, size int, version int, base bigint, done bigint, ticks bigint, price double"
KEPT = "symbol string, g bigint, t bigint, p double, v bigint"


def resizable_bars(ticks: DataFrame, orders: DataFrame, size: int, keep: int | None = 15_000, forming: bool = True) -> Triggers:
    """Bars of ``ticks`` (symbol, ts, seq, price, volume), whose size ``orders`` (symbol, ts, size) change; both are streams.

    A bar is complete, or forming and then shown again when it has grown. After an order a symbol's bars are a new version
    that begins with the oldest of its last ``keep`` ticks (None: of all); earlier versions are void. Ticks of a trigger are
    taken in the order of (ts, seq). Sizes below 1 count as 1. A trigger leaves its last ``keep`` ticks of a symbol on
    storage, which only triggers with an order read; those of earlier triggers aren't removed.
    """

    def make(batch: DataFrame, number: int, held: str) -> DataFrame:
        spark, by = batch.sparkSession, ["_symbol", "_none"]
        same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
        old = spark.read.schema(NOW).parquet(f"{held}/now/trigger={number - 1}") if number else spark.createDataFrame([], NOW)
        begun = spark.read.schema(KEPT).parquet(f"{held}/forming/trigger={number - 1}") if number else spark.createDataFrame([], KEPT)
        is_order = F.col("size").isNotNull()
        rows = batch.withColumns({"_symbol": F.coalesce("symbol", F.lit("")), "_none": F.isnull("symbol"), "_tick": F.when(is_order, 0).otherwise(1), "_order": F.when(is_order, 1).otherwise(0)})
        rows = numbered(rows, by, F.coalesce(F.expr("at div 60000000"), F.lit(1 << 62)), (F.asc_nulls_last("at"), "seq", "size"), "_i", ["_tick", "_order"], ["_g", "_v"])
        rows = stored(rows.select("symbol", "at", "price", "volume", "size", "_i", "_tick", "_g", "_v"), "events-now")
        # of each symbol with events: how it stands before the trigger, and its ticks after it
        heads = rows.groupBy("symbol").agg(F.sum("_tick").alias("_more"), F.max_by("price", F.when(F.col("_tick") == 1, F.col("_g"))).alias("_price"), F.sum(1 - F.col("_tick")).alias("_orders"))
        was = old.withColumnsRenamed({c: f"_0{c}" for c in old.columns})
        zero = lambda c, x=0: F.coalesce(f"_0{c}", F.lit(x))
        heads = heads.join(was, same("symbol", "_0symbol"), "left").select(
            "symbol", zero("size", size).alias("size"), zero("version").alias("version"), zero("base").alias("base"), zero("done").alias("done"), zero("ticks").alias("n"),
            (zero("ticks") + F.col("_more")).alias("end"), F.when(F.col("_more") > 0, F.col("_price")).otherwise(F.col("_0price")).alias("price"), "_orders",
        )
        heads = stored(heads, "heads")
        few = _few(heads.select(F.col("symbol").alias("_s"), "n", "end", F.col("version").alias("_v0")))
        rows = rows.join(few, same("symbol", "_s")).drop("_s")
        # a part for each version that has ticks in this trigger: the one that goes on, and one for each order
        placed = F.col("n") + F.col("_g")
        base = F.greatest(F.lit(0), placed - keep) if keep is not None else F.lit(0)
        fresh = rows.where("_tick = 0").select("symbol", F.greatest(F.lit(1), "size").alias("size"), (F.col("_v0") + F.col("_v")).cast("int").alias("version"), base.cast("bigint").alias("base"), placed.alias("_at"), "end")
        parts = heads.select("symbol", "size", "version", "base", F.col("done").alias("low"), F.lit(-1).cast("bigint").alias("_at"), "end", F.lit(True).alias("goes_on"))
        parts = parts.unionByName(fresh.withColumns({"low": F.col("base"), "goes_on": F.lit(False)}))
        later = F.lead("_at").over(Window.partitionBy("symbol").orderBy("version"))  # a row for each order
        parts = stored(parts.withColumns({"high": F.coalesce(later, "end"), "is_last": later.isNull()}).drop("_at"), "parts")
        new = rows.where("_tick = 1").select("symbol", (F.col("n") + F.col("_g") - 1).alias("g"), F.col("at").alias("t"), F.col("price").alias("p"), F.col("volume").alias("v"), "end")
        (new.where(F.col("g") >= F.col("end") - keep) if keep is not None else new).drop("end").write.mode("overwrite").parquet(f"{held}/ring/trigger={number}")
        every = new.drop("end").withColumn("of", F.lit("new")).unionByName(begun.withColumn("of", F.lit("forming")))
        if number and parts.where("not goes_on").limit(1).count():
            ring = spark.read.schema(KEPT).parquet(*[f"{held}/ring/trigger={i}" for i in range(number)])
            every = every.unionByName(ring.withColumn("of", F.lit("ring")))
        few = _few(parts.withColumnRenamed("symbol", "_s"))
        fits = (F.col("of") == "new") | (F.col("goes_on") == (F.col("of") == "forming"))
        inside = every.join(few, same("symbol", "_s") & (F.col("g") >= F.col("low")) & (F.col("g") < F.col("high")) & fits).withColumn("bar_no", F.expr("(g - base) div size"))
        done = F.expr("base + (end - base) div size * size")
        rest = inside.where(F.col("is_last") & (F.col("g") >= done)).select(*begun.columns)
        touched = heads.select(F.col("symbol").alias("_s"))
        others = lambda t: t.join(_few(touched), same("symbol", "_s"), "left_anti")
        rest.unionByName(others(begun)).write.mode("overwrite").parquet(f"{held}/forming/trigger={number}")
        now = parts.where("is_last").withColumn("done", done).join(heads.select(F.col("symbol").alias("_s"), "price"), same("symbol", "_s")).withColumnRenamed("end", "ticks")
        now.select(*old.columns).unionByName(others(old)).write.mode("overwrite").parquet(f"{held}/now/trigger={number}")
        bars = inside.groupBy("symbol", "version", "size", "bar_no", "is_last").agg(
            F.min_by("t", "g").alias("_a"), F.max_by("t", "g").alias("_b"), F.min_by("p", "g").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "g").alias("close"),
            F.sum("v").alias("volume"), F.count("*").cast("int").alias("ticks"),
        ).withColumn("complete", F.col("ticks") == F.col("size"))
        moment = lambda c: F.timestamp_micros(c).cast("timestamp").cast("timestamp_ntz")
        bars = bars.where(F.col("complete") | (F.col("is_last") & F.lit(forming))).withColumns({"open_time": moment("_a"), "close_time": moment("_b")})
        return bars.select(*[c.split()[0] for c in BARS.split(", ")])

    return Triggers(events(ticks, orders), T.StructType.fromDDL(BARS), make)


def last_version(bars: DataFrame) -> DataFrame:
    """Of each symbol the bars of its last version."""
    last = bars.groupBy("symbol").agg(F.max("version").alias("_last"))
    return bars.join(last, "symbol").where(F.col("version") == F.col("_last")).drop("_last")


def status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream of ``resizable_bars`` holds after its last trigger: size, version, ticks so far, last price, and the
    forming bar with its progress in percent (nulls and 0 if none is forming). A row for each symbol."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/held/now")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    number = max(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(path) if x.getPath().getName().startswith("trigger="))
    now = spark.read.schema(NOW).parquet(f"{checkpoint}/held/now/trigger={number}")
    tick = spark.read.schema(KEPT).parquet(f"{checkpoint}/held/forming/trigger={number}")
    forming = tick.groupBy(F.col("symbol").alias("_s")).agg(
        F.min_by("p", "g").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "g").alias("close"), F.sum("v").alias("volume"), F.count("*").cast("int").alias("forming_ticks")
    )
    progress = F.round(F.coalesce("forming_ticks", F.lit(0)) / F.col("size") * 100, 1)
    return now.join(forming, F.col("symbol").eqNullSafe(F.col("_s")), "left").select(
        "symbol", "size", "version", "ticks", "price", "open", "high", "low", "close", "volume", F.coalesce("forming_ticks", F.lit(0)).alias("forming_ticks"), progress.alias("progress_pct")
    )
