"""DuckDB forms of the state machines, as recursive queries that carry the state from bar to bar."""

from .indicator_sql import BB, FORMS, PC, TR
from .sql import W, ewm, over, roll, span, stages


def _walk(steps: list[str], first: str, then: str, names: str, out: str) -> str:
    """``first`` and ``then`` give the state columns ``names``; in ``then`` p is the state before and n the bar."""
    last = f"s{len(steps)}" if steps else "bars"
    head = stages(*steps).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return f"""{head},
m({names}, symbol, bar_no) AS (
  SELECT {first}, n.symbol, n.bar_no FROM {last} n WHERE n.bar_no = 0
  UNION ALL SELECT {then}, n.symbol, n.bar_no FROM {last} n JOIN m p ON n.symbol = p.symbol AND n.bar_no = p.bar_no + 1)
SELECT symbol, bar_no, {out} FROM m"""


_ST = [PC, f"{TR} AS tr", f"{ewm('tr', 0.1)} AS a10", "(high + low) / 2 + 3.0 * a10 AS up, (high + low) / 2 - 3.0 * a10 AS lo"]
_ST_D = "CASE WHEN n.close > p.u THEN 1 WHEN n.close < p.l THEN -1 ELSE p.d END"
_ST_KEEP = "NOT n.close > p.u AND NOT n.close < p.l"
_ST_THEN = (
    f"{_ST_D}, CASE WHEN {_ST_KEEP} AND p.d = -1 THEN least(n.up, p.u) ELSE n.up END, CASE WHEN {_ST_KEEP} AND p.d = 1 THEN greatest(n.lo, p.l) ELSE n.lo END, n.bar_no = 0"
)
_ST_OUT = "round(CASE WHEN is_first THEN 0.0 WHEN d = 1 THEN l ELSE u END, 6) AS supertrend, CAST(d AS INTEGER) AS supertrend_dir, round(u, 6) AS supertrend_upper, round(l, 6) AS supertrend_lower"
SUPERTREND = _walk(_ST, "1, n.up, n.lo, true", _ST_THEN, "d, u, l, is_first", _ST_OUT)


def supertrend_sql(n: int, factor: float) -> str:
    """The stop with another span and factor."""
    steps = [*_ST[:2], f"{ewm('tr', 1 / n)} AS a10", f"(high + low) / 2 + {factor} * a10 AS up, (high + low) / 2 - {factor} * a10 AS lo"]
    return _walk(steps, "1, n.up, n.lo, true", _ST_THEN, "d, u, l, is_first", _ST_OUT)


SIG_SUPERTREND = _walk(_ST, "1, n.up, n.lo, true", _ST_THEN, "d, u, l, is_first", "CAST(d AS INTEGER) AS signal")

_PS = [f"lag(low, 1) OVER {W} AS l1, coalesce(lag(low, 2) OVER {W}, lag(low, 1) OVER {W}) AS l2, lag(high, 1) OVER {W} AS h1, coalesce(lag(high, 2) OVER {W}, lag(high, 1) OVER {W}) AS h2"]
_RAW = "CASE WHEN p.d = 1 THEN least(p.s + p.af * (p.ep - p.s), n.l1, n.l2) ELSE greatest(p.s + p.af * (p.ep - p.s), n.h1, n.h2) END"
_FLIP = f"(CASE WHEN p.d = 1 THEN n.low < {_RAW} ELSE n.high > {_RAW} END)"
_FAR = "(CASE WHEN p.d = 1 THEN n.high > p.ep ELSE n.low < p.ep END)"
_PS_THEN = f"""CASE WHEN {_FLIP} THEN p.ep ELSE {_RAW} END, CASE WHEN {_FLIP} THEN -p.d ELSE p.d END,
  CASE WHEN {_FLIP} THEN CASE WHEN p.d = 1 THEN n.low ELSE n.high END WHEN {_FAR} THEN CASE WHEN p.d = 1 THEN n.high ELSE n.low END ELSE p.ep END,
  CASE WHEN {_FLIP} THEN 0.02::DOUBLE WHEN {_FAR} THEN least(p.af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE p.af END"""
_PS_FIRST = "n.low, 1, n.high, 0.02::DOUBLE"
PSAR = _walk(_PS, _PS_FIRST, _PS_THEN, "s, d, ep, af", "round(s, 6) AS psar, CAST(d AS INTEGER) AS psar_dir")
SIG_PSAR = _walk(_PS, _PS_FIRST, _PS_THEN, "s, d, ep, af", "CAST(d AS INTEGER) AS signal")

_CANDLES = [*FORMS["candles"][0], BB, "m AS mid, m + 2 * sd AS bu, m - 2 * sd AS bl"]
_TRIGGERS = {
    "Contrarian_BB_LargeBar": ("high >= bu * 0.998 AND range_ratio >= 1.25 AND close > open", "low <= bl * 1.002 AND range_ratio >= 1.25 AND close < open"),
    "Contrarian_BB_Consecutive": ("high >= bu * 0.999 AND consec_bull >= 2", "low <= bl * 1.001 AND consec_bear >= 2"),
    "Contrarian_Band_Reversal": (
        f"(lag(high) OVER {W} >= lag(bu) OVER {W} OR bar_no = 0) AND close < bu AND close < open", f"(lag(low) OVER {W} <= lag(bl) OVER {W} OR bar_no = 0) AND close > bl AND close > open"),
    "Contrarian_BB_PinBar": ("high >= bu AND upper_wick_ratio >= 0.35", "low <= bl AND lower_wick_ratio >= 0.35"),
    "Contrarian_Triple_Exhaustion": ("high >= bu * 0.999 AND consec_bull >= 2 AND range_ratio >= 1.15", "low <= bl * 1.001 AND consec_bear >= 2 AND range_ratio >= 1.15"),
}
_HOME = "(CASE WHEN p.d = 1 THEN n.close >= n.mid ELSE n.close <= n.mid END)"
_AGAINST = "(CASE WHEN p.d = 1 THEN n.sh ELSE n.lg END)"
_NEXT = f"CASE WHEN p.d = 0 THEN CASE WHEN n.sh THEN -1 WHEN n.lg THEN 1 ELSE 0 END WHEN {_AGAINST} THEN -p.d WHEN coalesce({_HOME}, false) OR p.age + 1 >= 5 THEN 0 ELSE p.d END"
_AGE = f"CASE WHEN p.d = 0 OR {_AGAINST} THEN 0 ELSE p.age + 1 END"
CONTRARIAN = {
    name: _walk([*_CANDLES, f"coalesce({a}, false) AS sh, coalesce({b}, false) AS lg"], "0, 0", f"{_NEXT}, {_AGE}", "d, age", "CAST(d AS INTEGER) AS signal") for name, (a, b) in _TRIGGERS.items()
}


def _past(fn: str, x: str, n: int) -> str:
    """fn over the n bars before this one, null until there are n."""
    return f"CASE WHEN count({x}) {over(n, 1)} >= {n} THEN {fn}({x}) {over(n, 1)} END"


def _breakout(reach: int, out_reach: int | None, width: float, ribbon: bool = False, add: bool = False) -> str:
    steps = [
        PC, f"{TR} AS tr, {span('close', 100)} AS e100, {span('close', 20)} AS e20, {span('close', 50)} AS e50",
        f"avg(tr) {over(20)} AS a, {_past('max', 'high', reach)} AS top, {_past('min', 'low', reach)} AS bot, {_past('min', 'low', out_reach or 1)} AS xl, {_past('max', 'high', out_reach or 1)} AS xh, {_past('max', 'high', 10)} AS t10, {_past('min', 'low', 10)} AS b10",
        "CASE WHEN close > top AND close > e100" + (" AND e20 > e50" if ribbon else "") + " THEN 1 WHEN close < bot AND close < e100" + (" AND e20 < e50" if ribbon else "") + " THEN -1 ELSE 0 END AS turn",
    ]
    ext = "(CASE WHEN p.d = 1 THEN greatest(p.ext, n.high) ELSE least(p.ext, n.low) END)"
    stop = f"(CASE WHEN p.d = 1 THEN {ext} - {width} * n.a ELSE {ext} + {width} * n.a END)"
    if out_reach:
        stop = f"(CASE WHEN p.d = 1 THEN greatest({stop}, n.xl) ELSE least({stop}, n.xh) END)"
    turned, out = "(n.turn <> 0 AND n.turn <> p.d)", f"(p.d <> 0 AND (CASE WHEN p.d = 1 THEN n.close < {stop} ELSE n.close > {stop} END))"
    more = "(p.d <> 0 AND p.u < 2 AND coalesce(CASE WHEN p.d = 1 THEN n.close > n.t10 ELSE n.close < n.b10 END, false) AND (n.close - p.last) * p.d >= 1.5 * n.a)" if add else "false"
    then = f"""CASE WHEN {turned} THEN n.turn WHEN {out} THEN 0 ELSE p.d END, CASE WHEN {turned} THEN 1 WHEN {out} THEN 0 WHEN {more} THEN 2 ELSE p.u END,
  CASE WHEN {turned} THEN CASE WHEN n.turn = 1 THEN n.high ELSE n.low END WHEN p.d <> 0 THEN {ext} ELSE p.ext END, CASE WHEN {turned} THEN n.close WHEN {out} THEN p.last WHEN {more} THEN n.close ELSE p.last END"""
    return _walk(steps, "0, 0, 0.0::DOUBLE, 0.0::DOUBLE", then, "d, u, ext, last", "CAST(d * u AS INTEGER) AS signal")


BREAKOUTS = {
    "Genius_NQ_Pyramiding_Trend": _breakout(25, None, 3.0, add=True),
    "Genius_NQ_Macro_Breakout": _breakout(25, 15, 3.5),
    "Genius_NQ_Adaptive_Ribbon": _breakout(20, 12, 3.2, ribbon=True),
}


def _gap(x: str, y: str, w: str, alpha: float) -> tuple[str, str]:
    """Next mean and weight of an exponential mean whose input x has gaps."""
    keep = 1 - alpha
    mean = f"CASE WHEN p.{y} IS NULL THEN n.{x} WHEN n.{x} IS NULL THEN p.{y} ELSE (p.{w} * {keep!r} * p.{y} + {alpha!r} * n.{x}) / (p.{w} * {keep!r} + {alpha!r}) END"
    return mean, f"CASE WHEN p.{y} IS NULL OR n.{x} IS NOT NULL THEN 1.0::DOUBLE ELSE p.{w} * {keep!r} END"


_DX = [*FORMS["adx_di"][0], "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx"]
_DX_THEN = ", ".join([*_gap("dx", "y", "w", 1 / 14), "n.plus_di", "n.minus_di"])
_DX_WALK = (_DX, "n.dx, 1.0::DOUBLE, n.plus_di, n.minus_di", _DX_THEN, "y, w, pdi, mdi")
ADX = _walk(*_DX_WALK, "round(y, 6) AS adx")
SIG_ADX = _walk(*_DX_WALK, "CAST(CASE WHEN pdi > mdi AND y > 20 THEN 1 WHEN mdi > pdi AND y > 20 THEN -1 ELSE 0 END AS INTEGER) AS signal")

_RVI = [f"{PC}, {roll('stddev_samp', 'close', 10)} AS sd", "CASE WHEN close > pc THEN sd ELSE 0.0 END AS us, CASE WHEN close < pc THEN sd ELSE 0.0 END AS ds"]
_RVI_WALK = (_RVI, "n.us, 1.0::DOUBLE, n.ds, 1.0::DOUBLE", ", ".join([*_gap("us", "u", "wu", 1 / 14), *_gap("ds", "d", "wd", 1 / 14)]), "u, wu, d, wd")
RVI = _walk(*_RVI_WALK, "round(coalesce(100 * u / (u + nullif(d, 0)), 50.0), 6) AS rvi")
SIG_RVI = _walk(*_RVI_WALK, "CASE WHEN coalesce(100 * u / (u + nullif(d, 0)), 50.0) > 50 THEN 1 ELSE -1 END AS signal")

SIGNALS = CONTRARIAN | BREAKOUTS | {"Supertrend": SIG_SUPERTREND, "Parabolic_SAR": SIG_PSAR, "ADX_DI": SIG_ADX, "RVI": SIG_RVI}
INDICATORS = {"supertrend": SUPERTREND, "psar": PSAR, "rvi": RVI, "adx": ADX}
