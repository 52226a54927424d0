"""Structured Streaming: bars of N ticks, running quotes, windows of event time, and trade actions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.windows import carried, chunk_window, in_chunks, lagged, numbered, own_rows
from ..operators.learning import features
from ..sources.shared import shared_path, stored

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def tick_stream(spark: SparkSession, sf_dir: str, files_a_trigger: int | None = None) -> DataFrame:
    """The events table, one file or a folder of part files, as a stream of ticks; ``files_a_trigger`` bounds what a trigger
    reads."""
    # as a pattern, since a stream takes a plain path for a folder
    reader = spark.readStream.schema(EVENTS)
    rows = (reader.option("maxFilesPerTrigger", files_a_trigger) if files_a_trigger else reader).parquet(f"{sf_dir}/events.parque[t]")
    return rows.select("ts", F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("bigint").alias("volume"))


BAR = (
    "symbol string, bar_no bigint, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double, volume bigint, ticks int, money double, bought bigint,"
    " complete boolean"
)
#: Symbols up to which a table with a row for each is broadcast.
FEW = 100_000


@dataclass(frozen=True)
class Triggers:
    """A stream that a batch plan makes trigger by trigger: ``make(batch, number, held)`` gives the rows of a trigger from what
    has come, and what the one before has left below ``held``, where it leaves its own. A repeated trigger does the same
    again. ``run_once`` and ``decide`` drive it."""

    source: DataFrame
    schema: T.StructType
    make: Callable[[DataFrame, int, str], DataFrame]


def in_order(ticks: DataFrame, before: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """``columns`` of a trigger's ticks with rn, their number in the order of (ts, seq) after those that came ``before`` (symbol,
    rn: how many, price: the last one), and bought, the volume of a tick that rose; ticks without a time come last.

    Numbers are counts of pieces put one after another and windows hold a minute of a symbol, so no task holds a symbol.
    """
    by, end = ["_symbol", "_none"], F.lit("9999-12-31").cast("timestamp_ntz")
    rows = ticks.withColumns({"_symbol": F.coalesce("symbol", F.lit("")), "_none": F.isnull("symbol")})
    piece = F.coalesce(F.date_trunc("minute", "ts"), end)
    rows = numbered(lagged(rows, by, piece, ("ts", "seq"), {"_before": "price"}), by, piece, ("ts", "seq"))
    if before is None:
        rows = rows.withColumns({"_n": F.lit(0), "_last": F.col("price")})
    else:
        known = before.select(F.col("symbol").alias("_known"), F.col("rn").alias("_n"), F.col("price").alias("_last"))
        known = F.broadcast(known) if known.limit(FEW + 1).count() <= FEW else known
        rows = rows.join(known, F.col("symbol").eqNullSafe(F.col("_known")), "left").withColumn("_last", F.when(F.col("_n").isNull(), F.col("price")).otherwise(F.col("_last")))
    rose = (F.col("price") > F.when(F.col("rn") == 1, F.col("_last")).otherwise(F.col("_before"))) & ~F.isnan("price")
    return rows.select(*columns, F.when(rose, F.col("volume")).otherwise(0).alias("bought"), (F.col("rn") + F.coalesce("_n", F.lit(0))).alias("rn"))


TICK = ("symbol", "ts", "price", "volume")


def live_bars(ticks: DataFrame, size: int, forming: bool = False) -> Triggers:
    """A bar whenever ``size`` ticks of a symbol have arrived; fewer than ``size`` ticks are held, and shown as a bar with
    ``forming``. money is the sum of price times volume, bought the volume of ticks that rose (a first tick did not).

    Ticks of one trigger are taken in the order of (ts, seq). A trigger is a batch plan whose tasks hold pieces of symbols, so
    it may be as large as the whole table.
    """
    size = int(size)

    def make(batch: DataFrame, number: int, held: str) -> DataFrame:
        spark, old = batch.sparkSession, None
        if number:
            old = spark.read.parquet(f"{held}/trigger={number - 1}")
            last = old.groupBy("symbol").agg(F.max_by("price", "rn").alias("price"), F.max("rn").alias("rn"))
        rows = in_order(batch, last if number else None, TICK).withColumn("is_done", F.lit(False))
        rows = stored(rows.unionByName(old) if number else rows, "ticks-now")
        # a held tick may be done: the last one, whose number and price the next trigger needs
        known = rows.groupBy(F.col("symbol").alias("_known")).agg(F.max("rn").alias("_n"))
        known = F.broadcast(known) if known.limit(FEW + 1).count() <= FEW else known
        left = rows.join(known, F.col("symbol").eqNullSafe(F.col("_known"))).withColumn("is_done", F.col("rn") <= F.expr(f"_n div {size} * {size}"))
        left.where(~F.col("is_done") | (F.col("rn") == F.col("_n"))).select(*rows.columns).write.mode("overwrite").parquet(f"{held}/trigger={number}")
        rows = rows.where(~F.col("is_done")).withColumn("bar_no", F.expr(f"(rn - 1) div {size}"))
        so_far = Window.partitionBy("symbol", "bar_no").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("money", F.sum(F.col("price") * F.col("volume")).over(so_far))  # in order, so that a bar's money is the same however it came
        bars = rows.groupBy("symbol", "bar_no").agg(
            F.min_by("ts", "rn").alias("open_time"), F.max_by("ts", "rn").alias("close_time"), F.min_by("price", "rn").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "rn").alias("close"),
            F.sum("volume").alias("volume"), F.count("*").cast("int").alias("ticks"), F.max_by("money", "rn").alias("money"), F.sum("bought").alias("bought"),
        ).withColumn("complete", F.col("ticks") == size)
        return bars if forming else bars.where("complete")

    return Triggers(ticks, T.StructType.fromDDL(BAR), make)


def rebuild(ticks: DataFrame, size: int) -> DataFrame:
    """The bars that ``live_bars`` would have with another size, from all ticks so far; the last one may be forming."""
    rows = numbered(ticks, ["symbol"], F.date_trunc("minute", "ts"), ("ts", "seq")).withColumn("bar_no", F.expr(f"(rn - 1) div {int(size)}"))
    bars = rows.groupBy("symbol", "bar_no").agg(
        F.min("ts").alias("open_time"), F.max("ts").alias("close_time"), F.min_by("price", "rn").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "rn").alias("close"), F.sum("volume").alias("volume"), F.count("*").cast("int").alias("ticks"),
    )
    return bars.withColumn("complete", F.col("ticks") == int(size))


QUOTE = "symbol string, ticks bigint, price double, change double, change_pct double, total_volume bigint, tps double"


def quotes(ticks: DataFrame, recent: int = 200) -> DataFrame:
    """Per symbol and trigger: last price, its change from the first, volume so far, ticks a second over the last arrivals."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, _, volume, times = state.get if state.exists else (0, None, 0.0, 0, [])
        oldest, newest = None, None  # of the trigger, by (ts, seq); no more of it is held than these
        for rows in frames:
            n, volume = n + len(rows), volume + int(rows["volume"].sum())
            rows = rows.sort_values(["ts", "seq"])
            oldest = pd.concat([oldest, rows.head(1)]).sort_values(["ts", "seq"]).head(1)
            newest = pd.concat([newest, rows.tail(recent)]).sort_values(["ts", "seq"]).tail(recent)
        price = float(newest["price"].iloc[-1])
        first = float(oldest["price"].iloc[0]) if first is None else first
        times = deque([*times, *(newest["ts"].astype("datetime64[us]").astype("int64") / 1e6)], recent)
        gone = times[-1] - times[0]
        state.update((n, first, price, volume, list(times)))
        yield pd.DataFrame([(key[0], n, price, price - first, (price / first - 1) * 100 if first else None, volume, (len(times) - 1) / gone if gone > 0 else 0.0)], columns=[x.split()[0] for x in QUOTE.split(", ")])

    return ticks.groupBy("symbol").applyInPandasWithState(step, QUOTE, "n bigint, first double, price double, volume bigint, times array<double>", "update", GroupStateTimeout.NoTimeout)


def windows(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling event-time bars with a watermark for late ticks."""
    rows = ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "symbol").agg(F.count("*").alias("ticks"), F.sum("volume").alias("volume"), F.max("price").alias("high"), F.min("price").alias("low"))


def run_once(stream: DataFrame | Triggers, name: str, mode: str = "append", latest_by: list[str] | None = None, marks: str | None = None) -> DataFrame:
    """Drive a stream over all that is there, into a table in the shared folder, and read that; with ``latest_by`` only the
    row of the last trigger for each key. A trigger that is repeated writes its rows anew. ``marks``: the checkpoint."""
    made = isinstance(stream, Triggers)
    source, fields = stream.source if made else stream, stream.schema.fields
    spark, columns = source.sparkSession, [f.name for f in fields]
    path, marks = shared_path(spark, name), marks or shared_path(spark, f"{name}-checkpoint")
    spark.createDataFrame([], T.StructType([*fields, T.StructField("at_trigger", T.LongType())])).write.parquet(f"{path}/trigger=none")  # so that an empty stream can be read

    def add(batch: DataFrame, number: int) -> None:
        batch = stream.make(batch, number, f"{marks}/held") if made else batch
        batch.withColumn("at_trigger", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    query = source.writeStream.outputMode("append" if made else mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(add).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*fields, T.StructField("at_trigger", T.LongType())])).option("recursiveFileLookup", "true").parquet(path)
    if latest_by:
        rows = rows.groupBy(*latest_by).agg(F.max_by(F.struct(*columns), "at_trigger").alias("x")).select("x.*")
    return rows.select(*columns)


def decide(bars: Triggers, path: str, label: Callable[[DataFrame], DataFrame], warm: int = 50, keep: int = 200, watch: Callable[[DataFrame], DataFrame] | None = None):
    """Start live decisions on a stream of complete bars (``live_bars``); the streaming query, which is not yet awaited.

    Each trigger takes the last ``keep`` bars of a symbol from the trigger before, makes features of them and the new ones,
    has ``label`` (a model) add the column label (1, 0, -1) to them, and writes the actions on the new bars from the
    ``warm``-th on below ``path``/decisions; the label of a bar that lacks a feature is 0. What the next trigger needs is written below ``path``/held, so a repeated
    trigger does the same again. ``watch`` makes counts of the features of the new bars (``model_versions.counted``), which
    are written below ``path``/drift, a folder for each trigger.
    """
    spark = bars.source.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        new = bars.make(batch, number, f"{path}/ticks-held").where("complete").withColumns({
            "bar_size": F.lit(0), "datetime": F.col("close_time"), "tick_count": F.col("ticks"), "vwap": F.col("money") / F.greatest(F.lit(1), "volume"), "buy_ratio": F.col("bought") / F.greatest(F.lit(1), "volume"),
            "bar_duration_sec": F.greatest(F.lit(0.1), F.expr("timestampdiff(MICROSECOND, open_time, close_time)") / 1e6), "is_new": F.lit(True), "position": F.lit(None).cast("int"),
        }).drop("complete", "money", "bought")
        both = new
        if number:
            both = new.unionByName(spark.read.schema(new.schema).parquet(f"{path}/held/trigger={number - 1}").withColumn("is_new", F.lit(False)))
        both = stored(both, "bars-now")  # at most ``keep`` old bars of a symbol
        first = both.groupBy("symbol").agg(F.min("bar_no").alias("_low"))
        # features want bars numbered from 0
        rows = both.join(first, "symbol").withColumn("bar_no", F.col("bar_no") - F.col("_low"))
        made = stored(features(rows.drop("_low", "is_new", "position")), "features-now")  # written before it is joined: see learning.labelled_features
        known = label(made).select("symbol", "bar_no", "label")
        if watch:
            fresh = made.join(rows.where("is_new").select("symbol", "bar_no"), ["symbol", "bar_no"], "left_semi")
            watch(fresh).write.mode("overwrite").parquet(f"{path}/drift/trigger={number}")
        rows = rows.join(known, ["symbol", "bar_no"], "left").withColumn("label", F.when(F.col("bar_no") + F.col("_low") >= warm - 1, F.coalesce("label", F.lit(0))).otherwise(0))
        rows = rows.withColumn("label", F.when(F.col("is_new"), F.col("label")).when(F.col("position") != 0, F.col("position")).otherwise(0))
        done = actions(rows)
        done = stored(done.withColumns({"bar_no": F.col("bar_no") + F.col("_low"), "position": F.col("target_pos")}), "decided")
        out = done.where(F.col("is_new") & (F.col("bar_no") >= warm - 1)).select("symbol", "bar_no", "datetime", "close", "label", "action", "target_pos", "take_profit", "stop_loss")
        out.write.mode("overwrite").parquet(f"{path}/decisions/trigger={number}")
        back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_no")))
        done.withColumn("_back", back).where(F.col("_back") <= keep).select(*new.columns).write.mode("overwrite").parquet(f"{path}/held/trigger={number}")

    return bars.source.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()


def actions(rows: DataFrame) -> DataFrame:
    """Trade actions from class labels (1, 0, -1) on bars: BUY or SELL when a label turns the position, HOLD else, each with
    target and stop.

    A label of 0 never changes the position, so it is that of the last other label. Target and stop are 2.0 and 1.5 mean
    ranges of the last 14 bars away, above and below for a label of 1 and the other way round for others.
    """
    by = [k for k in ("symbol", "bar_size") if k in rows.columns]
    w = chunk_window(by)
    turned = F.when(F.col("label") != 0, F.col("label"))
    rows = carried(in_chunks(rows, by, 16), by, {"_so_far": turned})
    held = F.coalesce(F.lag("_so_far").over(w), F.lit(0))
    rows = own_rows(rows.withColumns({"_held": held, "_range": F.avg(F.col("high") - F.col("low")).over(w.rowsBetween(-13, 0))}))
    held, span = F.col("_held"), F.col("_range")
    out = rows.withColumn("action", F.when((F.col("label") == 1) & (held <= 0), "BUY").when((F.col("label") == -1) & (held >= 0), "SELL").otherwise("HOLD"))
    out = out.withColumn("target_pos", F.coalesce(turned, held).cast("int"))
    way = F.when(F.col("label") == 1, 1).otherwise(-1)
    out = out.withColumn("take_profit", F.col("close") + way * 2.0 * span).withColumn("stop_loss", F.col("close") - way * 1.5 * span)
    return out.drop("_so_far", "_held", "_range")
