"""Trading signals from indicator columns: +1 long, -1 short, 0 flat (the pyramiding rule also +2 and -2).

A comparison with a missing value is false. Stateless rules are column expressions over indicators. Rules whose position
depends on their own past are state machines that stream along their series; what they look at is made by native columns.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .indicators import MACHINES, keys_of, machines_of, with_indicators
from .windows import carried, folded, in_chunks, own_rows, side_by_side

#: The names of the strategies and their categories.
TREND = (
    "Genius_NQ_Pyramiding_Trend Genius_NQ_Macro_Breakout Genius_NQ_Adaptive_Ribbon EMA_Cross MACD Ichimoku Supertrend ADX_DI Donchian_Channel VWAP"
    " Parabolic_SAR Keltner_Channel TRIX"
).split()
MOMENTUM = "RSI Stochastic CCI ROC MFI Williams_R CMO Stoch_RSI Ultimate_Oscillator TSI".split()
VOLATILITY = "Bollinger_Bands ATR_Breakout Keltner_Squeeze Chaikin_Volatility Historical_Volatility Ulcer_Index StdDev_Bands Choppiness_Index Mass_Index RVI".split()
CONTRARIAN = "Contrarian_BB_LargeBar Contrarian_BB_Consecutive Contrarian_Band_Reversal Contrarian_BB_PinBar Contrarian_Triple_Exhaustion".split()
CATEGORIES = {"TREND": TREND, "MOMENTUM": MOMENTUM, "VOLATILITY": VOLATILITY, "CONTRARIAN": CONTRARIAN, "ALL": [*TREND, *MOMENTUM, *VOLATILITY, *CONTRARIAN]}
STATEFUL = [*TREND[:3], *CONTRARIAN]


def canonical(name: str) -> str:
    """The strategy of this name in any case."""
    for known in CATEGORIES["ALL"]:
        if known.lower() == name.lower():
            return known
    raise ValueError(f"unknown strategy: {name}")


def _if(yes: Column, no: Column | None = None) -> Column:
    """1 where ``yes``; with ``no`` -1 where that holds and else 0, without it -1 everywhere else."""
    out = F.when(yes, 1)
    return (out.when(no, -1).otherwise(0) if no is not None else out.otherwise(-1)).cast("int")


#: What a stateless strategy looks at, beside open, high, low, close and vwap, and its rule.
STATELESS = {
    "EMA_Cross": ("ema_fast ema_slow", lambda c, x: _if(x("ema_fast") > x("ema_slow"))), "MACD": ("macd_line macd_signal", lambda c, x: _if(x("macd_line") > x("macd_signal"))),
    "Ichimoku": (
        "tenkan_sen kijun_sen senkou_span_a senkou_span_b",
        lambda c, x: _if((x("tenkan_sen") > x("kijun_sen")) & (c > F.coalesce("senkou_span_a", c)), (x("tenkan_sen") < x("kijun_sen")) & (c < F.coalesce("senkou_span_b", c))),
    ),
    "Supertrend": ("supertrend_dir", lambda c, x: x("supertrend_dir")), "Parabolic_SAR": ("psar_dir", lambda c, x: x("psar_dir")),
    "ADX_DI": ("plus_di minus_di adx", lambda c, x: _if((x("plus_di") > x("minus_di")) & (x("adx") > 20), (x("minus_di") > x("plus_di")) & (x("adx") > 20))),
    "Donchian_Channel": ("_last_broke", lambda c, x: F.coalesce("_last_broke", F.lit(0))),
    "VWAP": ("", lambda c, x: _if(c > x("vwap"))), "Keltner_Channel": ("kc_mid", lambda c, x: _if(c > x("kc_mid"))), "TRIX": ("trix trix_signal", lambda c, x: _if(x("trix") > x("trix_signal"))),
    "RSI": ("rsi", lambda c, x: _if(x("rsi") > 50)), "Stochastic": ("stoch_k stoch_d", lambda c, x: _if(x("stoch_k") > x("stoch_d"))), "CCI": ("cci", lambda c, x: _if(x("cci") > 0)),
    "ROC": ("roc", lambda c, x: _if(x("roc") > 0)), "MFI": ("mfi", lambda c, x: _if(x("mfi") > 50)), "Williams_R": ("williams_r", lambda c, x: _if(x("williams_r") > -50)), "CMO": ("cmo", lambda c, x: _if(x("cmo") > 0)),
    "Stoch_RSI": ("stoch_rsi_k stoch_rsi_d", lambda c, x: _if(x("stoch_rsi_k") > x("stoch_rsi_d"))), "Ultimate_Oscillator": ("uo", lambda c, x: _if(x("uo") > 50)), "TSI": ("tsi tsi_signal", lambda c, x: _if(x("tsi") > x("tsi_signal"))),
    "Bollinger_Bands": ("bb_pct_b", lambda c, x: _if(x("bb_pct_b") > 0.5)), "ATR_Breakout": ("atr_upper atr_lower", lambda c, x: _if(c > x("atr_upper"), c < x("atr_lower"))), "Keltner_Squeeze": ("squeeze_mom", lambda c, x: _if(x("squeeze_mom") > 0)),
    "Chaikin_Volatility": ("chaikin_vol _sma_20", lambda c, x: _if((x("chaikin_vol") > 0) & (c > F.coalesce("_sma_20", c)), (x("chaikin_vol") > 0) & (c < F.coalesce("_sma_20", c)))),
    "Historical_Volatility": ("_sma_20", lambda c, x: _if(c > F.coalesce("_sma_20", c))), "Ulcer_Index": ("ulcer_index _ulcer_mid", lambda c, x: _if(x("ulcer_index") < x("_ulcer_mid"))),
    "StdDev_Bands": ("stddev_mid", lambda c, x: _if(c > x("stddev_mid"))), "Choppiness_Index": ("chop ema_20", lambda c, x: _if((x("chop") < 50) & (c > x("ema_20")), (x("chop") < 50) & (c < x("ema_20")))),
    "Mass_Index": ("ema_20", lambda c, x: _if(c < x("ema_20"))), "RVI": ("rvi", lambda c, x: _if(x("rvi") > 50)),
}
#: What a contrarian strategy looks at, and its (short, long) entry conditions; false where a band is missing.
TRIGGERS = {
    "Contrarian_BB_LargeBar": ("range_ratio", lambda x: ((x("high") >= x("bb_upper") * 0.998) & (x("range_ratio") >= 1.25) & (x("close") > x("open")), (x("low") <= x("bb_lower") * 1.002) & (x("range_ratio") >= 1.25) & (x("close") < x("open")))),
    "Contrarian_BB_Consecutive": ("consec_bull consec_bear", lambda x: ((x("high") >= x("bb_upper") * 0.999) & (x("consec_bull") >= 2), (x("low") <= x("bb_lower") * 1.001) & (x("consec_bear") >= 2))),
    "Contrarian_Band_Reversal": ("_was_over _was_under", lambda x: (x("_was_over") & (x("close") < x("bb_upper")) & (x("close") < x("open")), x("_was_under") & (x("close") > x("bb_lower")) & (x("close") > x("open")))),
    "Contrarian_BB_PinBar": ("upper_wick_ratio lower_wick_ratio", lambda x: ((x("high") >= x("bb_upper")) & (x("upper_wick_ratio") >= 0.35), (x("low") <= x("bb_lower")) & (x("lower_wick_ratio") >= 0.35))),
    "Contrarian_Triple_Exhaustion": (
        "consec_bull consec_bear range_ratio",
        lambda x: ((x("high") >= x("bb_upper") * 0.999) & (x("consec_bull") >= 2) & (x("range_ratio") >= 1.15), (x("low") <= x("bb_lower") * 1.001) & (x("consec_bear") >= 2) & (x("range_ratio") >= 1.15)),
    ),
}
#: Breakouts: bars of the channel, bars of the opposite channel that is an exit (or none), width of the stop in mean true
#: ranges, whether the 20-bar mean must stand beyond the 50-bar one, whether a second unit is added.
BREAKOUTS = {TREND[0]: (25, None, 3.0, False, True), TREND[1]: (25, 15, 3.5, False, False), TREND[2]: (20, 12, 3.2, True, False)}


def hold(bar_size: int) -> int:
    """Bars that a contrarian position may last."""
    return 5 if bar_size <= 10_000 else 3 if bar_size <= 20_000 else 2


def contrarian(close: np.ndarray, mid: np.ndarray, short: np.ndarray, long: np.ndarray, most: int, state: tuple[int, int] | None = None) -> tuple[np.ndarray, tuple[int, int]]:
    """Enter against a trigger, leave at the middle band, after ``most`` bars, or into the opposite trigger. A series' first
    bar is flat. The state is the position and its age."""
    out = np.zeros(len(close), int)
    close, mid, short, long = (np.asarray(x).tolist() for x in (close, mid, short, long))  # plain numbers: several times as fast one by one
    for i in range(len(close)):
        if state is None:
            state = (0, 0)
            continue
        now, age = state
        if not now:
            now, age = (-1 if short[i] else 1 if long[i] else 0), 0
        else:
            age += 1
            against = short[i] if now > 0 else long[i]
            home = (close[i] - mid[i]) * now >= 0
            if against:
                now, age = -now, 0
            elif home or age >= most:
                now = 0
        out[i], state = now, (now, age)
    return out, state


def breakout(f: pd.DataFrame, name: str, state: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Channel breakout with a trend filter and a trailing stop from the extreme, on bars with _tr_mean, _turn (the side to
    which the bar breaks out), and the columns of the exit channel and of the 10 bars before. The state is the side, the
    units, the extreme and the price of the last entry."""
    _, out_reach, width, _, add = BREAKOUTS[name]
    close, high, low, span, turns = (f[x].to_numpy(float).tolist() for x in ("close", "high", "low", "_tr_mean", f"_turn_{name}"))
    exits = {1: f[f"_low_{out_reach}"].to_numpy(float).tolist(), -1: f[f"_high_{out_reach}"].to_numpy(float).tolist()} if out_reach else None
    more = {1: f["_high_10"].to_numpy(float).tolist(), -1: f["_low_10"].to_numpy(float).tolist()} if add else None
    out = np.zeros(len(f), int)
    for i in range(len(f)):
        if state is None:
            state = (0, 0, 0.0, 0.0)
            continue
        side, units, extreme, last = state
        turn = int(turns[i])
        if side:
            edge = high[i] if side > 0 else low[i]
            extreme = max(extreme * side, edge * side) * side
        if turn and turn != side:
            side, units, last, extreme = turn, 1, close[i], high[i] if turn > 0 else low[i]
        elif side:
            stop = (extreme - side * width * span[i]) * side
            if exits is not None and exits[side][i] * side > stop:
                stop = exits[side][i] * side
            if close[i] * side < stop:
                side = units = 0
            elif add and units < 2 and (close[i] - more[side][i]) * side > 0 and (close[i] - last) * side >= 1.5 * span[i]:
                units, last = 2, close[i]
        out[i], state = side * units, (side, units, extreme, last)
    return out, state


def fold_all(names: list[str]):
    """The fold of several state machines side by side."""

    def fold(f: pd.DataFrame, state: dict | None) -> tuple[dict, dict]:
        state, out = dict(state or {}), {}
        most = hold(int(f["bar_size"].iloc[0])) if "bar_size" in f else 5
        for n in names:
            if n in BREAKOUTS:
                out[n], state[n] = breakout(f, n, state.get(n))
            else:
                short, long = (f[f"_{n}_{k}"].to_numpy(bool) for k in ("short", "long"))
                out[n], state[n] = contrarian(f["close"].to_numpy(float), f["bb_mid"].to_numpy(float), short, long, most, state.get(n))
        return out, state

    return fold


def _turn(name: str) -> tuple[list[str], Column]:
    """Columns that a breakout needs, and the side to which a bar breaks out."""
    reach, out_reach, _, ribbon, add = BREAKOUTS[name]
    x, top, bottom = F.col, F.col(f"_high_{reach}"), F.col(f"_low_{reach}")
    rising, falling = (x("close") > top) & (x("close") > x("ema_100")), (x("close") < bottom) & (x("close") < x("ema_100"))
    needs = ["ema_100", "_tr_mean", f"_high_{reach}", f"_low_{reach}", *([f"_high_{out_reach}", f"_low_{out_reach}"] if out_reach else []), *(["_high_10", "_low_10"] if add else [])]
    if ribbon:
        rising, falling, needs = rising & (x("ema_20") > x("ema_50")), falling & (x("ema_20") < x("ema_50")), [*needs, "ema_20", "ema_50"]
    return needs, F.when(rising, 1).when(falling, -1).otherwise(0)


def with_signals(bars: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """Bars (with bar_no) with one int column per strategy; indicators are made as far as the strategies need them. A column
    named like a strategy in any case of letters (vwap) gives way to it."""
    names = list(dict.fromkeys(canonical(n) for n in (names or CATEGORIES["ALL"])))
    by, looped = keys_of(bars), [n for n in names if n in STATEFUL]
    turns = {n: _turn(n) for n in looped if n in BREAKOUTS}
    needs = [x for n in names if n in STATELESS for x in STATELESS[n][0].split()] + [x for n in turns for x in turns[n][0]]
    needs += [x for n in looped if n in TRIGGERS for x in ("bb_mid", "bb_upper", "bb_lower", *TRIGGERS[n][0].split())]
    machines = [m for m, (outs, *_) in MACHINES.items() if any(x in outs for x in needs)]
    late = {n for n in names if n in STATELESS and any(x in MACHINES[m][0] for m in machines for x in STATELESS[n][0].split())}
    plain = [x for x in needs if not any(x in MACHINES[m][0] for m in machines)] + [x for m in machines for x in MACHINES[m][1]]
    donchian = "_last_broke" in needs
    out = with_indicators(bars, ["_broke" if x == "_last_broke" else x for x in plain]) if plain else bars
    if donchian:
        out = own_rows(carried(in_chunks(out, by, 0), by, {"_last_broke": F.col("_broke")}))
    early = [n for n in names if n in STATELESS and n not in late]
    out = out.withColumns({n: STATELESS[n][1](F.col("close"), F.col) for n in early} | {f"_turn_{n}": t for n, (_, t) in turns.items()})
    if looped or machines:
        pairs = {n: TRIGGERS[n][1](F.col) for n in looped if n in TRIGGERS}
        out = out.withColumns({f"_{n}_{k}": F.coalesce(x, F.lit(False)) for n, pair in pairs.items() for k, x in zip(("short", "long"), pair, strict=True)})
        fold, outs, reads = machines_of(machines)
        reads += ["close", "high", "low", *(["bar_size"] if "bar_size" in by else [])] if looped else []
        reads += [x for n in looped for x in ([*turns[n][0], f"_turn_{n}"] if n in turns else ["bb_mid", f"_{n}_short", f"_{n}_long"])]
        # All machines run in one pass, over bars that keep what is read and the signals made so far.
        there, made = {*map(str.lower, bars.columns)}, {n.lower() for n in early}
        out = out.select(*[c for c in bars.columns if c.lower() not in made], *early, *dict.fromkeys(x for x in reads if x.lower() not in there))
        out = folded(out, by, side_by_side({"stops": fold, "rules": fold_all(looped)}), outs | {n: "int" for n in looped}, list(dict.fromkeys(reads)))
        out = out.withColumns({n: STATELESS[n][1](F.col("close"), F.col) for n in late})
    own = {n.lower() for n in names}
    return out.select(*[c for c in bars.columns if c.lower() not in own], *names)


def vote(names: Iterable[str]) -> Column:
    """Mean of the signals beyond 0.2 either way."""
    names = list(names)
    if not names:
        return F.lit(0)
    mean = sum((F.col(n) for n in names), F.lit(0)) / len(names)
    return F.when(mean > 0.2, 1).when(mean < -0.2, -1).otherwise(0)
