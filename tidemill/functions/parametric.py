"""Indicators whose spans are arguments, as columns and as a table function of SQL.

``with_indicator`` makes native columns over chunks of a series, as ``indicators`` does with fixed spans. ``register`` names
a polymorphic table function, so that SQL has them too:

    SELECT symbol, bar_no, rsi FROM indicator(TABLE(bars) PARTITION BY symbol ORDER BY (bar_no), 'rsi', map('n', 7))

Its result has the table's columns and the indicator's. It streams along a partition, of which it holds as many values as
the longest span has; for long series the columns are the better choice.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .indicators import MACHINES, keys_of, recipes, supertrend_fold
from .windows import CHUNK, WARM, chunk_window, ewm_steps, folded, in_chunks, own_rows, rolling, with_needed

Recipes = dict[str, tuple[tuple[str, ...], Callable[[], Column]]]


@dataclass(frozen=True)
class Spec:
    """defaults: parameters and their usual values; outputs: columns, all doubles but those in ``whole``; columns: recipes
    (given the keys and parameters) for them; machine: what makes them bar by bar; reach: bars that the windows look back on."""

    defaults: dict[str, float]
    outputs: tuple[str, ...]
    columns: Callable[[Sequence[str], dict], Recipes]
    machine: Callable[[dict], Callable[[dict], tuple]]
    reach: Callable[[dict], int]
    whole: tuple[str, ...] = ()


# ---- columns ----


def _mean(name: str, x: str, by: Sequence[str], n: float) -> Recipes:
    return ewm_steps(name, x, by, alpha=1 / n)


def _sma(by, p) -> Recipes:
    w = chunk_window(by)
    return {"sma": (("close",), lambda: rolling(F.avg, F.col("close"), p["n"], w))}


def _ema(by, p) -> Recipes:
    return ewm_steps("ema", "close", by, span=p["n"])


def _rsi(by, p) -> Recipes:
    ratio = lambda: F.try_divide(F.col("_p_gain"), F.col("_p_loss"))
    return _mean("_p_gain", "_up", by, p["n"]) | _mean("_p_loss", "_down", by, p["n"]) | {
        "rsi": (("_p_gain", "_p_loss"), lambda: F.coalesce(100 - 100 / (1 + ratio()), F.lit(50.0)))
    }


def _atr(by, p) -> Recipes:
    return _mean("atr", "_tr", by, p["n"])


def _macd(by, p) -> Recipes:
    return ewm_steps("_p_fast", "close", by, span=p["fast"]) | ewm_steps("_p_slow", "close", by, span=p["slow"]) | {
        "macd_line": (("_p_fast", "_p_slow"), lambda: F.col("_p_fast") - F.col("_p_slow")),
        "macd_hist": (("macd_line", "macd_signal"), lambda: F.col("macd_line") - F.col("macd_signal")),
    } | ewm_steps("macd_signal", "macd_line", by, span=p["signal"])


def _bollinger(by, p) -> Recipes:
    w = chunk_window(by)
    sd = {"_p_sd": (("close",), lambda: rolling(F.stddev_samp, F.col("close"), p["n"], w))}
    band = lambda k: (("bb_mid", "_p_sd"), lambda: F.col("bb_mid") + k * F.col("_p_sd"))
    return sd | {"bb_mid": (("close",), lambda: rolling(F.avg, F.col("close"), p["n"], w)), "bb_upper": band(p["k"]), "bb_lower": band(-p["k"])}


def _donchian(by, p) -> Recipes:
    w = chunk_window(by)
    return {
        "donchian_upper": (("high",), lambda: rolling(F.max, F.col("high"), p["n"], w)), "donchian_lower": (("low",), lambda: rolling(F.min, F.col("low"), p["n"], w)),
        "donchian_mid": (("donchian_upper", "donchian_lower"), lambda: (F.col("donchian_upper") + F.col("donchian_lower")) / 2),
    }


def _roc(by, p) -> Recipes:
    w = chunk_window(by)
    return {"roc": (("close",), lambda: (F.try_divide(F.col("close"), F.lag("close", p["n"]).over(w)) - 1) * 100)}


def _williams(by, p) -> Recipes:
    w = chunk_window(by)
    top, low = (lambda: rolling(F.max, F.col("high"), p["n"], w)), (lambda: rolling(F.min, F.col("low"), p["n"], w))
    return {"williams_r": (("high", "low", "close"), lambda: -100 * F.try_divide(top() - F.col("close"), top() - low()))}


def _supertrend(by, p) -> Recipes:
    edge = lambda k: (("high", "low", "_p_atr"), lambda: (F.col("high") + F.col("low")) / 2 + k * F.col("_p_atr"))
    return _mean("_p_atr", "_tr", by, p["n"]) | {"_st_up": edge(p["m"]), "_st_low": edge(-p["m"])}


# ---- bar by bar ----


class Window:
    """The last ``n`` values; whole when there are as many and none is missing."""

    def __init__(self, n: float):
        self.values: deque = deque(maxlen=int(n))

    def of(self, x: float | None, fn: Callable[[Sequence[float]], float]) -> float | None:
        self.values.append(x)
        return fn(self.values) if len(self.values) == self.values.maxlen and None not in self.values else None


class Mean:
    """Exponential mean from the first value on; missing values give none and change nothing."""

    def __init__(self, alpha: float):
        self.alpha, self.value = alpha, None

    def of(self, x: float | None) -> float | None:
        if x is None:
            return None
        self.value = x if self.value is None else self.value + self.alpha * (x - self.value)
        return self.value


class Ranges:
    """True ranges, rises and falls from the close before."""

    def __init__(self):
        self.before = None

    def of(self, bar: dict) -> tuple[float, float, float]:
        close, before = bar["close"], bar["close"] if self.before is None else self.before
        self.before = close
        spans = (bar["high"] - bar["low"], abs(bar["high"] - before), abs(bar["low"] - before))
        return max(spans), max(close - before, 0.0), max(before - close, 0.0)


def _spread(xs: Sequence[float]) -> float | None:
    mean = sum(xs) / len(xs)
    return math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) if len(xs) > 1 else None


def _average(xs: Sequence[float]) -> float:
    return sum(xs) / len(xs)


def _run_sma(p):
    w = Window(p["n"])
    return lambda bar: (w.of(bar["close"], _average),)


def _run_ema(p):
    m = Mean(2 / (p["n"] + 1))
    return lambda bar: (m.of(bar["close"]),)


def _run_rsi(p):
    r, gain, loss = Ranges(), Mean(1 / p["n"]), Mean(1 / p["n"])

    def step(bar):
        _, up, down = r.of(bar)
        g, x = gain.of(up), loss.of(down)
        return (100 - 100 / (1 + g / x) if x else 50.0,)

    return step


def _run_atr(p):
    r, m = Ranges(), Mean(1 / p["n"])
    return lambda bar: (m.of(r.of(bar)[0]),)


def _run_macd(p):
    fast, slow, signal = (Mean(2 / (p[k] + 1)) for k in ("fast", "slow", "signal"))

    def step(bar):
        line = fast.of(bar["close"]) - slow.of(bar["close"])
        held = signal.of(line)
        return line, held, line - held

    return step


def _run_bollinger(p):
    a, b = Window(p["n"]), Window(p["n"])

    def step(bar):
        mid, sd = a.of(bar["close"], _average), b.of(bar["close"], _spread)
        return (mid, None, None) if sd is None else (mid, mid + p["k"] * sd, mid - p["k"] * sd)

    return step


def _run_donchian(p):
    a, b = Window(p["n"]), Window(p["n"])

    def step(bar):
        top, low = a.of(bar["high"], max), b.of(bar["low"], min)
        return top, low, None if top is None else (top + low) / 2

    return step


def _run_roc(p):
    past = deque(maxlen=int(p["n"]))

    def step(bar):
        old = past[0] if len(past) == past.maxlen else None
        past.append(bar["close"])
        return ((bar["close"] / old - 1) * 100 if old else None,)

    return step


def _run_williams(p):
    a, b = Window(p["n"]), Window(p["n"])

    def step(bar):
        top, low = a.of(bar["high"], max), b.of(bar["low"], min)
        return (-100 * (top - bar["close"]) / (top - low) if top is not None and top != low else None,)

    return step


def _run_supertrend(p):
    import pandas as pd

    r, m, state = Ranges(), Mean(1 / p["n"]), [None]

    def step(bar):
        mid, span = (bar["high"] + bar["low"]) / 2, m.of(r.of(bar)[0])
        made, state[0] = supertrend_fold(pd.DataFrame({"close": [bar["close"]], "_st_up": [mid + p["m"] * span], "_st_low": [mid - p["m"] * span]}), state[0])
        return tuple(made[c][0].item() for c in SPECS["supertrend"].outputs)

    return step


SPECS: dict[str, Spec] = {
    "sma": Spec({"n": 20}, ("sma",), _sma, _run_sma, lambda p: p["n"]),
    "ema": Spec({"n": 20}, ("ema",), _ema, _run_ema, lambda p: WARM),
    "rsi": Spec({"n": 14}, ("rsi",), _rsi, _run_rsi, lambda p: WARM),
    "atr": Spec({"n": 14}, ("atr",), _atr, _run_atr, lambda p: WARM),
    "macd": Spec({"fast": 12, "slow": 26, "signal": 9}, ("macd_line", "macd_signal", "macd_hist"), _macd, _run_macd, lambda p: WARM),
    "bollinger": Spec({"n": 20, "k": 2.0}, ("bb_mid", "bb_upper", "bb_lower"), _bollinger, _run_bollinger, lambda p: p["n"]),
    "donchian": Spec({"n": 20}, ("donchian_upper", "donchian_lower", "donchian_mid"), _donchian, _run_donchian, lambda p: p["n"]),
    "roc": Spec({"n": 12}, ("roc",), _roc, _run_roc, lambda p: p["n"] + 1),
    "williams_r": Spec({"n": 14}, ("williams_r",), _williams, _run_williams, lambda p: p["n"]),
    "supertrend": Spec({"n": 10, "m": 3.0}, ("supertrend", "supertrend_dir", "supertrend_upper", "supertrend_lower"), _supertrend, _run_supertrend, lambda p: WARM, ("supertrend_dir",)),
}
#: Parameters that are factors, not numbers of bars.
FACTORS = ("k", "m")


def checked(name: str, given: dict) -> dict:
    """The parameters of an indicator with their defaults. A ValueError for an unknown name or parameter, and for a span that
    isn't a whole number of bars from 2 to a chunk's."""
    if name not in SPECS:
        raise ValueError(f"no indicator {name}; there are {', '.join(SPECS)}")
    unknown = set(given) - set(SPECS[name].defaults)
    if unknown:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}; it has {', '.join(SPECS[name].defaults)}")
    out = SPECS[name].defaults | given
    for k, v in out.items():
        if k not in FACTORS and (v != int(v) or not 2 <= v < CHUNK):
            raise ValueError(f"{name}: {k} must be a whole number from 2 to {CHUNK - 1}")
    return {k: float(v) if k in FACTORS else int(v) for k, v in out.items()}


def with_indicator(bars: DataFrame, name: str, **parameters: float) -> DataFrame:
    """Bars (with bar_no) and the indicator's columns; a column of the same name gives way."""
    spec, p, by = SPECS.get(name), checked(name, parameters), keys_of(bars)
    bars = bars.drop(*spec.outputs)
    book = recipes(by) | spec.columns(by, p)
    machine = name in MACHINES
    wanted = list(MACHINES[name][1]) if machine else list(spec.outputs)
    # what the recipes with fixed spans are called may not be taken for these
    rows = own_rows(with_needed(in_chunks(bars, by, max(2, spec.reach(p) + 1 if spec.reach(p) < WARM else spec.reach(p))), wanted, book))
    if machine:
        outs, needs, fold = MACHINES[name]
        rows = folded(rows, by, fold, outs, needs)
    return rows.select(*bars.columns, *spec.outputs)


class Indicator:
    """The table function: a table, an indicator's name and a map of its parameters."""

    @staticmethod
    def analyze(table, name, parameters=None):
        from pyspark.sql.udtf import AnalyzeResult

        spec = SPECS[name.value] if name.value in SPECS else None
        checked(name.value, dict(parameters.value or {}) if parameters is not None else {})
        kept = [f for f in table.dataType.fields if f.name not in spec.outputs]
        made = [T.StructField(c, T.IntegerType() if c in spec.whole else T.DoubleType()) for c in spec.outputs]
        return AnalyzeResult(T.StructType([*kept, *made]))

    def __init__(self):
        self.step = None

    def eval(self, row, name, parameters=None):
        if self.step is None:
            self.spec = SPECS[name]
            self.step = self.spec.machine(checked(name, dict(parameters or {})))
        bar = row.asDict()
        prices = {k: bar[k] for k in ("high", "low", "close")}
        # a bar without a price has no figures and changes none
        made = [None] * len(self.spec.outputs) if None in prices.values() else self.step({k: float(v) for k, v in prices.items()})
        yield (*(v for k, v in bar.items() if k not in self.spec.outputs), *made)


def register(spark: SparkSession, name: str = "indicator") -> None:
    """Makes the table function known to SQL. Bars must have prices."""
    spark.udtf.register(name, F.udtf(Indicator))
