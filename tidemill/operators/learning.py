"""Features, labels, splits, drift and models on bar series."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import with_indicators
from ..functions.windows import chunk_window, in_chunks, numbered, own_rows, quantiles, rolling
from ..sources.shared import stored
from . import boosting, search

#: The names of the features.
FEATURES = (
    "ret_1 ret_3 ret_5 ret_10 atr_14 atr_pct ema_diff_10 ema_diff_30 ema_ratio_10_30 rsi_14 macd_hist bb_pct_b bb_bandwidth vol_surge_ratio vwap_disparity"
    " buy_ratio buy_ratio_ma5 session_progress is_open_hour is_close_hour day_of_week ticks_per_sec ticks_per_sec_log"
).split()


def _keys(bars: DataFrame) -> list[str]:
    return [k for k in ("symbol", "bar_size") if k in bars.columns]


def features(bars: DataFrame) -> DataFrame:
    """Keys, bar_no, datetime, close_raw and the FEATURES, each from the bar before; rows with a missing one are dropped.

    Bars need datetime, buy_ratio and bar_duration_sec beside the usual columns.
    """
    by = _keys(bars)
    w, c, col = chunk_window(by), F.col("close"), F.col
    mean = lambda x, n: rolling(F.avg, col(x), n, w)
    prior = lambda n: F.lag("close", n).over(w)
    more = {
        "_rise_or_0": (("_move",), lambda: F.greatest(F.coalesce("_move", F.lit(0.0)), F.lit(0.0))), "_fall_or_0": (("_move",), lambda: F.greatest(-F.coalesce("_move", F.lit(0.0)), F.lit(0.0))),
        "_atr_14": (("_tr",), lambda: mean("_tr", 14)), "_volume": (("volume",), lambda: col("volume").cast("double")), "_volume_20": (("_volume",), lambda: mean("_volume", 20)),
        "_minute": (("datetime",), lambda: F.hour("datetime") * 60 + F.minute("datetime") - 540), "_unit": (("_atr_14",), lambda: col("_atr_14") + 1e-6),
        "_rate": (("tick_count", "bar_duration_sec"), lambda: col("tick_count") / col("bar_duration_sec")),
    }
    made = {f"ret_{n}": (("close",), lambda n=n: F.try_divide(c - prior(n), prior(n))) for n in (1, 3, 5, 10)} | {
        "atr_14": (("_atr_14",), lambda: col("_atr_14")), "atr_pct": (("_atr_14",), lambda: col("_atr_14") / (c + 1e-6)),
        "ema_diff_10": (("_ema_10", "_unit"), lambda: (c - col("_ema_10")) / col("_unit")), "ema_diff_30": (("_ema_30", "_unit"), lambda: (c - col("_ema_30")) / col("_unit")),
        "ema_ratio_10_30": (("_ema_10", "_ema_30", "_unit"), lambda: (col("_ema_10") - col("_ema_30")) / col("_unit")),
        "rsi_14": (("_rise_or_0", "_fall_or_0"), lambda: 100 - 100 / (1 + mean("_rise_or_0", 14) / (mean("_fall_or_0", 14) + 1e-8))),
        "macd_hist": (("_hist", "_unit"), lambda: col("_hist") / col("_unit")),
        "bb_pct_b": (("bb_mid", "_sd_20"), lambda: (c - col("bb_mid") + 2 * col("_sd_20")) / (4 * col("_sd_20") + 1e-8)), "bb_bandwidth": (("bb_mid", "_sd_20"), lambda: 4 * col("_sd_20") / (col("bb_mid") + 1e-8)),
        "vol_surge_ratio": (("_volume_20",), lambda: col("volume") / (col("_volume_20") + 1e-6)), "vwap_disparity": (("_unit",), lambda: (c - col("vwap")) / col("_unit")),
        "buy_ratio": ((), lambda: col("buy_ratio")), "buy_ratio_ma5": ((), lambda: mean("buy_ratio", 5)),
        "session_progress": (("_minute",), lambda: F.least(F.greatest(col("_minute"), F.lit(0)), F.lit(405)) / 405.0), "is_open_hour": (("_minute",), lambda: (col("_minute") <= 60).cast("double")),
        "is_close_hour": (("_minute",), lambda: (col("_minute") >= 360).cast("double")), "day_of_week": ((), lambda: F.weekday("datetime") / 4.0),
        "ticks_per_sec": (("_rate",), lambda: col("_rate")), "ticks_per_sec_log": (("_rate",), lambda: F.log1p("_rate")),
    }
    made = {f"_f_{k}": v for k, v in made.items()}
    hist = {"_hist": (("macd_line", "macd_signal"), lambda: col("macd_line") - col("macd_signal"))}
    before = {f"_b_{k}": ((f"_f_{k}",), lambda k=k: F.lag(f"_f_{k}").over(w)) for k in FEATURES}
    rows = with_indicators(bars, list(before), more | hist | made | before)
    return rows.select(*by, "bar_no", "datetime", c.alias("close_raw"), *[col(f"_b_{k}").alias(k) for k in FEATURES]).dropna(subset=FEATURES)


def triple_barrier(bars: DataFrame, up: float = 2.0, down: float = 1.5, ahead: int = 15) -> DataFrame:
    """label and ret: which barrier the next ``ahead`` bars meet first (the upper one is looked at first in a bar)."""
    by = _keys(bars)
    w, c = chunk_window(by), F.col("close")
    prior = F.coalesce(F.lag("close").over(w), c)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))
    rows = in_chunks(bars, by, 16, ahead).withColumn("_tr", tr).withColumn("_atr", F.avg("_tr").over(w.rowsBetween(-13, 0)))
    nexts = F.collect_list(F.struct("high", "low", "close")).over(w.rowsBetween(1, ahead))
    rows = rows.withColumn("_top", c + up * F.col("_atr")).withColumn("_floor", c - down * F.col("_atr")).withColumn("_next", nexts)
    hit = F.filter(F.transform("_next", lambda b: F.when(b["high"] >= F.col("_top"), 1).when(b["low"] <= F.col("_floor"), -1)), lambda x: x.isNotNull())
    rows = rows.withColumn("label", F.coalesce(F.get(hit, F.lit(0)), F.lit(0)))
    end = F.when(F.size("_next") > 0, F.col("_next")[F.size("_next") - 1]["close"]).otherwise(c)
    exit_ = F.when(F.col("label") == 1, F.col("_top")).when(F.col("label") == -1, F.col("_floor")).otherwise(end)
    rows = own_rows(rows.withColumn("ret", F.coalesce(F.try_divide(exit_ - c, c), F.lit(0.0))))
    return rows.drop("_tr", "_atr", "_top", "_floor", "_next")


def forward_return(bars: DataFrame, n: int = 5) -> DataFrame:
    by = _keys(bars)
    ahead = F.lead("close", n).over(chunk_window(by))
    return own_rows(in_chunks(bars, by, 0, n).withColumn("fwd_ret", F.try_divide(ahead - F.col("close"), F.col("close"))))


def sequences(rows: DataFrame, columns: Sequence[str], length: int) -> DataFrame:
    """For each row (with bar_no) with ``length`` rows before it: their values as an array of vectors, oldest first."""
    by = _keys(rows)
    w = chunk_window(by).rowsBetween(-length, -1)
    return own_rows(in_chunks(rows, by, length).withColumn("sequence", F.collect_list(F.array(*columns)).over(w)).where(F.size("sequence") == length))


def patches(sequence: Column, length: int = 4, stride: int = 2) -> Column:
    """Overlapping stretches of a sequence."""
    return F.transform(F.sequence(F.lit(1), F.size(sequence) - length + 1, F.lit(stride)), lambda i: F.slice(sequence, i, F.lit(length)))


def walk_forward(rows: DataFrame, at: str, train_days: int = 500, test_days: int = 125, embargo: float = 0.01) -> DataFrame:
    """Rows with fold and part ('train', 'test'): rolling windows over the days that occur, one row per fold it is in.

    The first int(test_days * embargo) days of each test are left out. If there are too few days for a fold and over 100
    rows, one fold of the first 75 % against the rest.
    """
    days = rows.select(F.to_date(at).alias("_day")).distinct().withColumn("_d", F.row_number().over(Window.orderBy("_day")) - 1)
    total = days.count()
    folds = max(0, (total - train_days - test_days) // test_days + 1)
    if not folds:
        n = rows.count()
        if n <= 100:
            return rows.withColumn("fold", F.lit(0)).withColumn("part", F.lit("train")).limit(0)
        ranked = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], F.to_date(at), [at], "_i").drop("_all")
        return ranked.withColumn("fold", F.lit(0)).withColumn("part", F.when(F.col("_i") <= int(n * 0.75), "train").otherwise("test")).drop("_i")
    skip = int(test_days * embargo)
    lay = days.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("_o", F.col("_d") - F.col("fold") * test_days)
    part = F.when(F.col("_o").between(0, train_days - 1), "train").when(F.col("_o").between(train_days + skip, train_days + test_days - 1), "test")
    lay = lay.withColumn("part", part).where("part is not null").select("_day", "fold", "part")
    return rows.withColumn("_day", F.to_date(at)).join(lay, "_day").drop("_day")


def purged_folds(rows: DataFrame, at: Sequence[str], folds: int = 4, embargo: float = 0.01) -> DataFrame:
    """Rows with fold and part: contiguous test stretches, training rows no nearer than int(n * embargo)."""
    n = rows.count()
    size, gap = n // folds, int(n * embargo)
    out = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], F.to_date(at[0]), at, "_i").drop("_all").withColumn("_i", F.col("_i") - 1)
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    begin, end = F.col("fold") * size, F.when(F.col("fold") < folds - 1, (F.col("fold") + 1) * size).otherwise(n)
    part = F.when((F.col("_i") >= begin) & (F.col("_i") < end), "test").when((F.col("_i") < begin - gap) | (F.col("_i") >= end + gap), "train")
    return out.withColumn("part", part).where("part is not null").drop("_i")


def psi(expected: DataFrame, actual: DataFrame, columns: Sequence[str], buckets: int = 10) -> DataFrame:
    """Population stability index per column, over the deciles of ``expected``."""
    at = [i / buckets for i in range(1, buckets)]
    long = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))).where("x is not null")
    cuts = quantiles(long(expected), ["feature"], "x", at).select("feature", F.col("quantiles").alias("cuts"))
    cuts = stored(cuts, "cuts")  # a row for each column; both sides read it
    shares = []
    for side, df in (("e", expected), ("a", actual)):
        rows = long(df).join(F.broadcast(cuts), "feature")
        rows = rows.withColumn("bucket", F.size(F.filter("cuts", lambda q: F.col("x") >= q)))
        counts = rows.groupBy("feature", "bucket").agg(F.count("*").alias("n"))
        shares.append(counts.withColumn(side, F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).drop("n"))
    grid = cuts.select("feature", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    both = grid.join(shares[0], ["feature", "bucket"], "left").join(shares[1], ["feature", "bucket"], "left")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-4)) for c in ("e", "a"))
    return both.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def drift(scores: DataFrame, threshold: float = 0.25) -> DataFrame:
    """One row: mean index, drifted features and whether drift is found."""
    out = scores.agg(F.avg("psi").alias("mean_psi"), F.count_if(F.col("psi") >= threshold).alias("drifted"), F.count("*").alias("features"))
    return out.withColumn("is_drift", (F.col("mean_psi") >= threshold) | (F.col("drifted") > F.col("features") * 0.3))


def models(columns: Sequence[str], label: str = "label", seed: int = 42) -> dict:
    """Pipelines of pyspark.ml: scaled logistic regression and random forest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    vector = VectorAssembler(inputCols=list(columns), outputCol="_raw")
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
    own = {"labelCol": label, "featuresCol": "_x"}
    return {
        "logistic": Pipeline(stages=[vector, scaled, LogisticRegression(maxIter=100, regParam=1e-4, **own)]),
        "forest": Pipeline(stages=[vector, scaled, RandomForestClassifier(numTrees=100, maxDepth=6, seed=seed, **own)]),
    }


def labelled_features(bars: DataFrame, columns: Sequence[str] = FEATURES, **barriers) -> DataFrame:
    """Keys, bar_no, datetime, close_raw, the feature ``columns`` and label (``triple_barrier``) of each bar that has them.

    Features are written before they are joined: what Spark infers about two dozen columns that are never null, through
    all the steps that make them, is more than its optimizer can compare in a join.
    """
    by = _keys(bars)
    made = stored(features(bars), "features").select(*by, "bar_no", "datetime", "close_raw", *columns)
    return made.join(triple_barrier(bars, **barriers).select(*by, "bar_no", "label"), [*by, "bar_no"])


def train_and_predict(folds: DataFrame, columns: Sequence[str], model: str = "forest", seed: int = 42, shape: boosting.Shape | None = None) -> DataFrame:
    """Predictions for each fold's test rows by a model of its training rows (logistic, forest or boosted); labels -1, 0, 1.
    Fitting passes over the rows many times, so they are stored, and so are each fold's predictions. No folds give no rows."""
    folds = stored(folds, "folds")
    parts = [folds.limit(0).withColumn("predicted", F.lit(None).cast("int"))]
    for fold in sorted(r[0] for r in folds.select("fold").distinct().collect()):  # a number for each fold
        rows = folds.where(F.col("fold") == fold)
        train, test = rows.where("part = 'train'"), rows.where("part = 'test'")
        if model == "boosted":
            part = boosting.fit(train, columns, shape=shape or boosting.Shape(seed=seed)).predict(test).drop("probability")
        else:
            with_class = F.col("label").cast("double") + 1
            fitted = models(columns, "_label", seed)[model].fit(train.withColumn("_label", with_class))
            part = fitted.transform(test).withColumn("predicted", (F.col("prediction") - 1).cast("int")).drop("_raw", "_x", "rawPrediction", "probability", "prediction")
        parts.append(stored(part, "predictions"))
    return functools.reduce(DataFrame.unionByName, parts)


#: What a search of boosted trees looks at.
SPACE = {
    "rounds": search.Range(4, 12, whole=True), "depth": search.Range(2, 4, whole=True), "rate": search.Range(0.05, 0.3, log=True),
    "rows_share": search.Range(0.6, 1.0), "columns_share": search.Range(0.6, 1.0),
}


def tuned(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "label", space: dict[str, search.Range] | None = None, trials: int = 10, seed: int = 42, **how) -> tuple[boosting.Boosted, list[search.Trial]]:
    """Boosted trees with the parameters of the best trial, and all trials; a trial's score is its accuracy on ``test``."""
    train, test = (stored(x.select(*columns, label), "search-rows") for x in (train, test))
    shape_of = lambda found: boosting.Shape(seed=seed, **found)

    def score(found: dict) -> float:
        rows = boosting.fit(train, columns, label, shape_of(found)).predict(test)
        return rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] or 0.0

    done = search.search(train.sparkSession, space or SPACE, score, trials, seed=seed, **how)
    return boosting.fit(train, columns, label, shape_of(search.best(done).parameters)), done


def save_model(model, path: str, columns: Sequence[str], **facts: str) -> None:
    """The fitted pipeline below ``path``/model and what is known of it as JSON below ``path``/facts."""
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(list(columns), {k: str(v) for k, v in facts.items()})], "features array<string>, facts map<string,string>").write.mode("overwrite").json(f"{path}/facts")


def load_model(path: str, columns: Sequence[str] | None = None):
    """(model, facts, columns that are missing or too many against ``columns``)."""
    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    row = SparkSession.getActiveSession().read.schema("features array<string>, facts map<string,string>").json(f"{path}/facts").first()
    apart = sorted(set(row["features"]) ^ set(columns)) if columns is not None else []
    return PipelineModel.load(f"{path}/model"), row["facts"], apart
