"""Streams and file formats, driven over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strategies
from ..operators import backtest as T
from ..operators import bars as B
from ..operators import learning as L
from ..operators import model_versions
from ..sources import cdt, csv_ticks
from ..sources.shared import shared_path, stored
from ..streaming import live, resizable
from .indicator_sql import SIGNALS
from .more_queries import CURVE_SQL, DEALS, labelled_folds, signal_rows
from .sql import SERIES, TICKS, stages
from .tick_queries import query, series


@query(
    "stream_live_bars",
    f"""WITH {TICKS}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 60 AS bar_no FROM t)
SELECT symbol, bar_no, min(ts) AS open_time, max(ts) AS close_time, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(count(*) AS INTEGER) AS ticks,
  round(sum(price * volume), 4) AS money
FROM n GROUP BY symbol, bar_no HAVING count(*) = 60""",
)
def stream_live_bars(spark, sf_dir):
    bars = live.run_once(live.live_bars(live.tick_stream(spark, sf_dir), 60), "live-bars")
    return bars.withColumn("money", F.round("money", 4)).drop("complete", "bought")


@query(
    "rebuild_bars",
    f"""WITH {TICKS}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 45 AS bar_no FROM t)
SELECT symbol, bar_no, min(ts) AS open_time, max(ts) AS close_time, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume,
  CAST(count(*) AS INTEGER) AS ticks, count(*) = 45 AS complete FROM n GROUP BY symbol, bar_no""",
)
def rebuild_bars(spark, sf_dir):
    return live.rebuild(B.event_ticks(spark, sf_dir), 45)


def rule(rows):
    """Stands in for a model: the sign of the return over three bars. A bar without features (a return over 1, 3, 5 or 10
    bars is missing where the earlier close is 0) gets no label from a model, so ``live.decide`` gives it 0."""
    return rows.withColumn("label", F.signum("ret_3").cast("int"))


@query(
    "stream_decisions",
    f"""WITH {TICKS}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 12 AS bar_no FROM t),
b AS (SELECT symbol, bar_no, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close FROM n GROUP BY symbol, bar_no HAVING count(*) = 12),
l AS (SELECT *, avg(high - low) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING) AS span,
  CASE WHEN bar_no >= 49 AND least(abs(lag(close, 2) OVER w), abs(lag(close, 6) OVER w), abs(lag(close, 11) OVER w)) > 0
    THEN CAST(coalesce(sign((lag(close, 1) OVER w - lag(close, 4) OVER w) / nullif(lag(close, 4) OVER w, 0)), 0) AS INTEGER) ELSE 0 END AS label FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
h AS (SELECT *, coalesce(last_value(nullif(label, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM l)
SELECT symbol, bar_no, label, CASE WHEN label = 1 AND held <= 0 THEN 'BUY' WHEN label = -1 AND held >= 0 THEN 'SELL' ELSE 'HOLD' END AS action, CAST(CASE WHEN label <> 0 THEN label ELSE held END AS INTEGER) AS target_pos,
  round(close + CASE label WHEN 1 THEN 2.0 ELSE -2.0 END * span, 6) AS take_profit, round(close - CASE label WHEN 1 THEN 1.5 ELSE -1.5 END * span, 6) AS stop_loss FROM h WHERE bar_no >= 49""",
)
def stream_decisions(spark, sf_dir):
    path = shared_path(spark, "decisions")
    live.decide(live.live_bars(live.tick_stream(spark, sf_dir), 12), path, rule).awaitTermination()
    rows = spark.read.schema("symbol string, bar_no bigint, label int, action string, target_pos int, take_profit double, stop_loss double").option("recursiveFileLookup", "true").parquet(f"{path}/decisions")
    return rows.select("symbol", "bar_no", "label", "action", "target_pos", F.round("take_profit", 6).alias("take_profit"), F.round("stop_loss", 6).alias("stop_loss"))


def resized(spark, sf_dir):
    """Bars of 60 ticks whose size becomes 45 at each symbol's first tick after the middle of the month; the stream's output
    and its checkpoint."""
    middle = B.event_ticks(spark, sf_dir).where("trade_date >= '2024-01-16'").groupBy("symbol").agg(F.min("ts").alias("ts"))
    path, marks = shared_path(spark, "orders"), shared_path(spark, "resized-checkpoint")
    middle.withColumn("size", F.lit(45)).write.parquet(path)
    orders = spark.readStream.schema("symbol string, ts timestamp_ntz, size int").parquet(path)
    stream = resizable.resizable_bars(live.tick_stream(spark, sf_dir), orders, 60, keep=None)
    return live.run_once(stream, "resized", "update", ["symbol", "version", "bar_no"], marks), marks


@query(
    "stream_resized_bars",
    f"""WITH {TICKS}, c AS (SELECT symbol, count(*) FILTER (trade_date >= DATE '2024-01-16') > 0 AS is_changed FROM t GROUP BY symbol),
n AS (SELECT *, CASE WHEN is_changed THEN 45 ELSE 60 END AS size, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // CASE WHEN is_changed THEN 45 ELSE 60 END AS bar_no FROM t JOIN c USING (symbol))
SELECT symbol, CAST(size AS INTEGER) AS size, CAST(bar_no AS BIGINT) AS bar_no, min(ts) AS open_time, max(ts) AS close_time, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, CAST(count(*) AS INTEGER) AS ticks, count(*) = size AS complete FROM n GROUP BY symbol, size, bar_no""",
)
def stream_resized_bars(spark, sf_dir):
    return resizable.last_version(resized(spark, sf_dir)[0]).drop("version")


@query(
    "stream_status",
    f"""WITH {TICKS}, c AS (SELECT symbol, CASE WHEN count(*) FILTER (trade_date >= DATE '2024-01-16') > 0 THEN 45 ELSE 60 END AS size, count(*) AS ticks, last(price ORDER BY ts, seq) AS price FROM t GROUP BY symbol),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS i FROM t),
f AS (SELECT symbol, first(n.price ORDER BY ts, seq) AS open, max(n.price) AS high, min(n.price) AS low, last(n.price ORDER BY ts, seq) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS k
  FROM n JOIN c USING (symbol) WHERE i >= ticks // size * size GROUP BY symbol)
SELECT symbol, CAST(size AS INTEGER) AS size, ticks, price, open, high, low, close, volume, CAST(coalesce(k, 0) AS INTEGER) AS forming_ticks, round(coalesce(k, 0) / size * 100, 1) AS progress_pct FROM c LEFT JOIN f USING (symbol)""",
)
def stream_status(spark, sf_dir):
    """The forming bars and totals as they stand when the stream has ended."""
    _, marks = resized(spark, sf_dir)
    return resizable.status(spark, marks).drop("version")


def fitted_model(spark, sf_dir):
    """Boosted trees of the labelled bars, saved as a version and loaded by its number: model, training counts."""
    root, rows = shared_path(spark, "models"), labelled_folds(spark, sf_dir, False)
    number = model_versions.save(spark, root, L.boosting.fit(rows, L.FEATURES, shape=L.boosting.Shape(rounds=4, depth=3)), rows)
    return model_versions.load(spark, root, number)[:2]


def decided(spark, stream, path, model):
    """Drive ``live.decide`` with a model and read what it has decided."""
    label = lambda rows: model.predict(rows).withColumnRenamed("predicted", "label")
    live.decide(live.live_bars(stream, 30), path, label, warm=40, watch=lambda rows: model_versions.counted(model, rows)).awaitTermination()
    schema = "symbol string, bar_no bigint, label int, action string, target_pos int, take_profit double, stop_loss double"
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/decisions")


@query("stream_model_decisions")
def stream_model_decisions(spark, sf_dir):
    """Decisions of a pinned version of fitted trees on a stream of 30-tick bars."""
    model, _ = fitted_model(spark, sf_dir)
    rows = decided(spark, live.tick_stream(spark, sf_dir), shared_path(spark, "decisions"), model)
    return rows.withColumns({c: F.round(c, 6) for c in ("take_profit", "stop_loss")})


@query("stream_drift")
def stream_drift(spark, sf_dir):
    """How far the features of the streamed bars have drifted from those that the trees were fitted on."""
    model, expected = fitted_model(spark, sf_dir)
    path = shared_path(spark, "decisions")
    decided(spark, live.tick_stream(spark, sf_dir), path, model)
    seen = spark.read.schema(model_versions.COUNTS).option("recursiveFileLookup", "true").parquet(f"{path}/drift")
    return model_versions.psi(expected, seen).select("feature", F.round("psi", 6).alias("psi"))


@query(
    "stream_quotes",
    f"""WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS back FROM t)
SELECT symbol, count(*) AS ticks, last(price ORDER BY ts, seq) AS price, round(last(price ORDER BY ts, seq) - first(price ORDER BY ts, seq), 6) AS change, CAST(sum(volume) AS BIGINT) AS total_volume,
  round((count(*) FILTER (back <= 200) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts) FILTER (back <= 200))) / 1e6), 6) AS tps FROM n GROUP BY symbol""",
)
def stream_quotes(spark, sf_dir):
    rows = live.run_once(live.quotes(live.tick_stream(spark, sf_dir)), "quotes", "update", ["symbol"])
    return rows.select("symbol", "ticks", "price", F.round("change", 6).alias("change"), "total_volume", F.round("tps", 6).alias("tps"))


@query(
    "stream_windows",
    f"""WITH {TICKS}, w AS (SELECT symbol, date_trunc('hour', ts) AS h, count(*) AS ticks, CAST(sum(volume) AS BIGINT) AS volume, max(price) AS high, min(price) AS low FROM t GROUP BY ALL)
SELECT symbol, CAST(epoch_us(h) // 1000000 AS BIGINT) AS start_s, ticks, volume, high, low FROM w WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM t)""",
)
def stream_windows(spark, sf_dir):
    rows = live.run_once(live.windows(live.tick_stream(spark, sf_dir)), "windows")
    return rows.select("symbol", F.unix_timestamp("window.start").alias("start_s"), "ticks", "volume", "high", "low")


@query(
    "live_actions",
    stages(
        *SIGNALS["ATR_Breakout"][0],
        f"{SIGNALS['ATR_Breakout'][1]} AS label",
        f"avg(high - low) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING) AS span, coalesce(last_value(nullif(label, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held",
        "CASE WHEN label = 1 AND held <= 0 THEN 'BUY' WHEN label = -1 AND held >= 0 THEN 'SELL' ELSE 'HOLD' END AS action",
        "CASE label WHEN 1 THEN 1 ELSE -1 END AS way",
    )
    + f"SELECT symbol, bar_no, action, CAST(CASE WHEN label <> 0 THEN label ELSE held END AS INTEGER) AS target_pos, round(close + way * 2.0 * span, 6) AS take_profit, round(close - way * 1.5 * span, 6) AS stop_loss FROM s{len(SIGNALS['ATR_Breakout'][0]) + 4}",
)
def live_actions(spark, sf_dir):
    rows = strategies.with_signals(series(spark, sf_dir), ["ATR_Breakout"])
    done = live.actions(rows.withColumn("label", F.col("ATR_Breakout")))
    return done.select("symbol", "bar_no", "action", "target_pos", F.round("take_profit", 6).alias("take_profit"), F.round("stop_loss", 6).alias("stop_loss"))


@query("csv_round_trip", f"WITH {TICKS} SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, count(*) AS ticks, round(sum(price), 4) AS price, CAST(sum(volume) AS BIGINT) AS volume FROM t GROUP BY 1")
def csv_round_trip(spark, sf_dir):
    """The ticks written as one CSV per day and read back by the tick reader (seconds remain)."""
    path = shared_path(spark, "ticks-csv")
    ticks = B.event_ticks(spark, sf_dir)
    # the reader takes the date from the file's name or from the cell; here the cell has it
    rows = ticks.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "price", "volume", F.to_date("ts").alias("day"), "seq")
    rows.repartition("day").sortWithinPartitions("day", "seq").select("time", "price", "volume").write.option("header", "true").csv(path)
    back = csv_ticks.read_ticks(spark, path)
    return back.groupBy("ts").agg(F.count("*").alias("ticks"), F.round(F.sum("price"), 4).alias("price"), F.sum("volume").alias("volume"))


@query("sync_ticks", f"WITH {TICKS} SELECT count(*) AS total_ticks, count(DISTINCT trade_date) AS days FROM t")
def sync_ticks(spark, sf_dir):
    """The ticks written as CSV, loaded by a first sync, and by a second one that finds only suspect files to load again."""
    path, table, manifest = (shared_path(spark, f"sync-{x}") for x in ("csv", "table", "manifest"))
    rows = B.event_ticks(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "price", "volume", F.to_date("ts").alias("day"), "seq")
    rows.repartition("day").sortWithinPartitions("day", "seq").select("time", "price", "volume").write.option("header", "true").csv(path)
    csv_ticks.sync(spark, path, table, manifest)
    csv_ticks.sync(spark, path, table, manifest)
    days = spark.read.parquet(table).agg(F.countDistinct(F.to_date("ts")).alias("days"))
    return csv_ticks.sync_status(spark, table, manifest).select("total_ticks").crossJoin(days)  # a row each


@query("sync_incremental", f"WITH {TICKS} SELECT count(*) AS total_ticks, count(*) FILTER (trade_date = (SELECT max(trade_date) FROM t)) AS loaded_later, CAST(0 AS BIGINT) AS loaded_again FROM t")
def sync_incremental(spark, sf_dir):
    """All days but the last in one folder, loaded; then the last day in another one, and a sync of both, which reads the new
    files alone; then one that finds nothing to do."""
    early, late, table, manifest = (shared_path(spark, f"sync-{x}") for x in ("early", "late", "table", "manifest"))
    ticks, bounds = B.event_ticks(spark, sf_dir), csv_ticks.Bounds(float("inf"), float("-inf"), 0)
    last = ticks.agg(F.max("trade_date")).first()[0]
    rows = ticks.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "price", "volume", "trade_date", "seq")
    for keep, path in ((F.col("trade_date") < last, early), (F.col("trade_date") == last, late)):
        rows.where(keep).repartition("trade_date").sortWithinPartitions("seq").select("time", "price", "volume").write.option("header", "true").csv(path)
    syncs = [stored(csv_ticks.sync(spark, paths, table, manifest, bounds=bounds), "manifest") for paths in (early, [early, late], [early, late])]
    times = [m.agg(F.max("synced_at")).first()[0] for m in syncs[:2]]
    after = lambda t: F.coalesce(F.sum(F.when(F.col("synced_at") > t, F.col("row_count"))), F.lit(0))
    return syncs[2].agg(F.sum("row_count").alias("total_ticks"), after(times[0]).alias("loaded_later"), after(times[1]).alias("loaded_again"))


CDT_OUT = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS timestamp, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, CAST(volume AS DOUBLE) AS volume, {1} AS trading_value"


@query("cdt_round_trip", f"WITH {SERIES} SELECT symbol, {CDT_OUT.format('open_time', 'round(close * volume, 4)')} FROM bars")
def cdt_round_trip(spark, sf_dir):
    """One CDT file for each symbol, written and read back."""
    path = shared_path(spark, "cdt")
    cdt.write(series(spark, sf_dir), "symbol", path).count()
    rows = cdt.read(spark, path).withColumn("symbol", F.regexp_replace("file", r"\.cdt$", ""))
    return rows.select("symbol", "timestamp", "open", "high", "low", "close", "volume", F.round("trading_value", 4).alias("trading_value"))


@query("csv_to_cdt", f"WITH {TICKS} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, count(*) AS ticks, round(sum(price), 2) AS price, CAST(sum(volume) AS DOUBLE) AS volume FROM t GROUP BY 1")
def csv_to_cdt(spark, sf_dir):
    """The ticks written as CSV, every file turned into a CDT file, and these read."""
    path, to = shared_path(spark, "ticks-csv"), shared_path(spark, "ticks-cdt")
    rows = B.event_ticks(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "price", "volume", F.to_date("ts").alias("day"), "seq")
    rows.repartition("day").sortWithinPartitions("day", "seq").select("time", "price", "volume").write.option("header", "true").csv(path)
    cdt.csv_to_cdt(spark, path, to).count()
    back = cdt.read(spark, to)
    return back.groupBy("timestamp").agg(F.count("*").alias("ticks"), F.round(F.sum("close"), 2).alias("price"), F.sum("volume").alias("volume"))


@query("trade_log", CURVE_SQL + DEALS + " SELECT symbol, strategy, trade_no, side, bars_held, round(entry_price, 4) AS entry_price, round(exit_price, 4) AS exit_price FROM tr")
def trade_log(spark, sf_dir):
    """The trades as CSV files by series, read back."""
    path = shared_path(spark, "trade-log")
    log = T.trades(T.equity(signal_rows(spark, sf_dir)))
    csv_ticks.write_trades(log, path)
    back = spark.read.schema(log.schema).option("header", "true").csv(path)
    return back.select("symbol", "strategy", "trade_no", "side", "bars_held", *[F.round(c, 4).alias(c) for c in ("entry_price", "exit_price")])
