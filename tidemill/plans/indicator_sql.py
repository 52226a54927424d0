"""DuckDB forms of the indicators and of the signals that need no loop."""

from .sql import W, ewm, lag, over, roll, rounded, span, stages

TR = "greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close)))"
PC = f"{lag('close')} AS pc"


def _div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def _hl(n: int) -> str:
    return f"({roll('max', 'high', n)} - {roll('min', 'low', n)})"


EMA20 = f"{span('close', 20)} AS ema_20"
RSI = [PC, "CASE WHEN close > pc THEN close - pc ELSE 0.0 END AS up, CASE WHEN close < pc THEN pc - close ELSE 0.0 END AS dn", f"{ewm('up', 1 / 14)} AS g, {ewm('dn', 1 / 14)} AS l", f"coalesce(100 - 100 / (1 + {_div('g', 'l')}), 50.0) AS rsi"]
BB = f"{roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS sd"
ATR = [PC, f"{TR} AS tr", f"{ewm('tr', 1 / 14)} AS atr, {span('tr', 10)} AS atr10, {span('tr', 20)} AS atr20"]
STOCH = [f"100 * {_div('close - ' + '(' + roll('min', 'low', 14) + ')', _hl(14))} AS fk", f"{roll('avg', 'fk', 3)} AS stoch_k", f"{roll('avg', 'stoch_k', 3)} AS stoch_d"]
TYP = ["(high + low + close) / 3 AS tp", f"{lag('tp')} AS ptp", "CASE WHEN tp > ptp THEN tp * volume ELSE 0.0 END AS fin, CASE WHEN tp < ptp THEN tp * volume ELSE 0.0 END AS fout"]
STREAK = [f"row_number() OVER {W} AS rn", "CASE WHEN rn = 1 OR NOT close > open THEN rn END AS nb, CASE WHEN rn = 1 OR NOT close < open THEN rn END AS ns"]

#: name: (stages, columns, columns not rounded)
FORMS: dict[str, tuple[list[str], str, str]] = {
    "ema_cross": ([f"{span('close', 9)} AS ema_fast, {span('close', 21)} AS ema_slow", "ema_fast - ema_slow AS ema_diff"], "ema_fast ema_slow ema_diff", ""),
    "macd": ([f"{span('close', 12)} AS f, {span('close', 26)} AS s", "f - s AS macd_line", f"{span('macd_line', 9)} AS macd_signal", "macd_line - macd_signal AS macd_hist"], "macd_line macd_signal macd_hist", ""),
    "ichimoku": (
        [f"({roll('max', 'high', 9)} + {roll('min', 'low', 9)}) / 2 AS tenkan_sen, ({roll('max', 'high', 26)} + {roll('min', 'low', 26)}) / 2 AS kijun_sen, ({roll('max', 'high', 52)} + {roll('min', 'low', 52)}) / 2 AS m52",
         f"lag((tenkan_sen + kijun_sen) / 2, 26) OVER {W} AS senkou_span_a, lag(m52, 26) OVER {W} AS senkou_span_b, lead(close, 26) OVER {W} AS chikou_span"],
        "tenkan_sen kijun_sen senkou_span_a senkou_span_b chikou_span", ""),
    "adx_di": (
        [PC, f"{TR} AS tr, high - {lag('high')} AS mu, {lag('low')} - low AS md", "CASE WHEN mu > md AND mu > 0 THEN mu ELSE 0.0 END AS pdm, CASE WHEN md > mu AND md > 0 THEN md ELSE 0.0 END AS mdm",
         f"{ewm('tr', 1 / 14)} AS a, {ewm('pdm', 1 / 14)} AS p, {ewm('mdm', 1 / 14)} AS q", f"100 * {_div('p', 'a')} AS plus_di, 100 * {_div('q', 'a')} AS minus_di"], "plus_di minus_di", ""),
    "donchian": ([f"{roll('max', 'high', 20)} AS donchian_upper, {roll('min', 'low', 20)} AS donchian_lower", "(donchian_upper + donchian_lower) / 2 AS donchian_mid"], "donchian_upper donchian_lower donchian_mid", ""),
    "vwap_bands": (
        [f"coalesce({_div(f'sum(close * volume) {over(20)}', f'sum(volume) {over(20)}')}, close) AS rv", f"coalesce(stddev_samp(close - rv) {over(20)}, 0) AS so", "rv + 2 * so AS vwap_upper, rv - 2 * so AS vwap_lower"],
        "vwap_upper vwap_lower", ""),
    "keltner": ([*ATR, EMA20.replace("ema_20", "kc_mid"), "kc_mid + 2 * atr10 AS kc_upper, kc_mid - 2 * atr10 AS kc_lower"], "kc_mid kc_upper kc_lower", ""),
    "trix": ([f"{span('close', 14)} AS e1", f"{span('e1', 14)} AS e2", f"{span('e2', 14)} AS e3", f"({_div('e3', lag('e3'))} - 1) * 100 AS trix", f"{span('trix', 9)} AS trix_signal", "trix - trix_signal AS trix_hist"], "trix trix_signal trix_hist", ""),
    "rsi": (RSI, "rsi", ""),
    "stochastic": (STOCH, "stoch_k stoch_d", ""),
    "cci": (["(high + low + close) / 3 AS tp", f"list(tp) {over(20)} AS xs", "list_avg(xs) AS mu", "CASE WHEN len(xs) >= 20 THEN " + _div("tp - mu", "0.015 * list_avg(list_transform(xs, lambda x: abs(x - mu)))") + " END AS cci"], "cci", ""),
    "roc": ([f"({_div('close', lag('close', 12))} - 1) * 100 AS roc"], "roc", ""),
    "mfi": ([*TYP, f"coalesce(100 - 100 / (1 + {_div('(' + roll('sum', 'fin', 14) + ')', '(' + roll('sum', 'fout', 14) + ')')}), 50.0) AS mfi"], "mfi", ""),
    "williams_r": ([f"-100 * {_div('(' + roll('max', 'high', 14) + ') - close', _hl(14))} AS williams_r"], "williams_r", ""),
    "cmo": ([*RSI[:2], f"{roll('sum', 'up', 14)} AS u, {roll('sum', 'dn', 14)} AS d", f"100 * {_div('u - d', 'u + d')} AS cmo"], "cmo", ""),
    "stoch_rsi": ([*RSI, f"{_div('rsi - (' + roll('min', 'rsi', 14) + ')', '((' + roll('max', 'rsi', 14) + ') - (' + roll('min', 'rsi', 14) + '))')} * 100 AS sr", f"{roll('avg', 'sr', 3)} AS stoch_rsi_k", f"{roll('avg', 'stoch_rsi_k', 3)} AS stoch_rsi_d"], "stoch_rsi_k stoch_rsi_d", ""),
    "ultimate": (
        [PC, "CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END AS bp, CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END AS sp",
         "100 * (" + " + ".join(f"{k} * {_div('(' + roll('sum', 'bp', n) + ')', '(' + roll('sum', 'sp', n) + ')')}" for k, n in ((4, 7), (2, 14), (1, 28))) + ") / 7 AS uo"], "uo", ""),
    "tsi": (
        [PC, "close - pc AS d, abs(close - pc) AS ad", f"{span('d', 25)} AS d1, {span('ad', 25)} AS a1", f"{span('d1', 13)} AS d2, {span('a1', 13)} AS a2", f"100 * {_div('d2', 'a2')} AS tsi", f"{span('tsi', 7)} AS tsi_signal"],
        "tsi tsi_signal", ""),
    "bollinger": ([BB, f"m AS bb_mid, m + 2 * sd AS bb_upper, m - 2 * sd AS bb_lower, {_div('4 * sd', 'm')} AS bb_width, {_div('close - m + 2 * sd', '4 * sd')} AS bb_pct_b"], "bb_mid bb_upper bb_lower bb_width bb_pct_b", ""),
    "atr_breakout": ([*ATR, f"{roll('avg', 'close', 14)} AS m", "m + 2 * atr AS atr_upper, m - 2 * atr AS atr_lower"], "atr atr_upper atr_lower", ""),
    "squeeze": (
        [*ATR, f"{EMA20}, {BB}", "close - ema_20 AS d", f"coalesce((m - 2 * sd > ema_20 - 1.5 * atr20) AND (m + 2 * sd < ema_20 + 1.5 * atr20), false) AS squeeze_on,"
         f" coalesce(({roll('avg', 'd', 20)}) + 9.5 * (CASE WHEN count(d) {over(20)} >= 20 THEN regr_slope(d, bar_no) {over(20)} END), 0.0) AS squeeze_mom"], "squeeze_mom", "squeeze_on"),
    "chaikin": (["high - low AS hl", f"{span('hl', 10)} AS e", f"({_div('e', lag('e', 10))} - 1) * 100 AS chaikin_vol"], "chaikin_vol", ""),
    "historical_vol": ([PC, "CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS lr", f"({roll('stddev_samp', 'lr', 20)}) * sqrt(252) * 100 AS hv"], "hv", ""),
    "ulcer": ([f"{roll('max', 'close', 14)} AS mx", f"100 * {_div('close - mx', 'mx')} AS dd", "dd * dd AS q", f"sqrt({roll('avg', 'q', 14)}) AS ulcer_index"], "ulcer_index", ""),
    "stddev_bands": ([BB, "m AS stddev_mid, m + 2 * sd AS stddev_upper, m - 2 * sd AS stddev_lower, sd AS stddev_val"], "stddev_mid stddev_upper stddev_lower stddev_val", ""),
    "choppiness": ([*ATR[:2], f"100 * log10(nullif({_div('(' + roll('sum', 'tr', 14) + ')', _hl(14))}, 0)) / log10(14) AS chop"], "chop", ""),
    "mass_index": (["high - low AS hl", f"{span('hl', 9)} AS e1", f"{span('e1', 9)} AS e2", f"{_div('e1', 'e2')} AS r", f"{roll('sum', 'r', 25)} AS mass_index"], "mass_index", ""),
    "candles": (
        [*STREAK, "high - low AS bar_range, abs(close - open) AS bar_body",
         f"coalesce({_div('bar_range', f'avg(bar_range) {over(20)}')}, 1.0) AS range_ratio, coalesce({_div('bar_body', f'avg(bar_body) {over(20)}')}, 1.0) AS body_ratio,"
         f" coalesce({_div('high - greatest(open, close)', 'high - low')}, 0.0) AS upper_wick_ratio, coalesce({_div('least(open, close) - low', 'high - low')}, 0.0) AS lower_wick_ratio,"
         f" CAST(rn - max(nb) OVER {W} AS INTEGER) AS consec_bull, CAST(rn - max(ns) OVER {W} AS INTEGER) AS consec_bear"],
        "bar_range bar_body range_ratio body_ratio upper_wick_ratio lower_wick_ratio", "consec_bull consec_bear"),
}


def indicator_sql(name: str) -> str | None:
    """None for recurrences that need a recursive query."""
    if name not in FORMS:
        return None
    steps, columns, exact = FORMS[name]
    return f"{stages(*steps)}SELECT {rounded(columns, exact)} FROM s{len(steps)}"


def _sign(yes: str, no: str = "") -> str:
    return f"CASE WHEN {yes} THEN 1 {f'WHEN {no} THEN -1 ELSE 0' if no else 'ELSE -1'} END"


#: strategy: (indicator forms needed, condition SQL)
SIGNALS: dict[str, tuple[list[str], str]] = {
    "EMA_Cross": (FORMS["ema_cross"][0], _sign("ema_fast > ema_slow")),
    "MACD": (FORMS["macd"][0], _sign("macd_line > macd_signal")),
    "Ichimoku": (FORMS["ichimoku"][0], _sign("tenkan_sen > kijun_sen AND close > coalesce(senkou_span_a, close)", "tenkan_sen < kijun_sen AND close < coalesce(senkou_span_b, close)")),
    "Donchian_Channel": (
        [*FORMS["donchian"][0], f"CASE WHEN bar_no >= 20 AND close > {lag('donchian_upper')} THEN 1 WHEN bar_no >= 20 AND close < {lag('donchian_lower')} THEN -1 END AS ev"],
        "coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING), 0)"),
    "VWAP": (["1 AS one"], _sign("close > vwap")),
    "Keltner_Channel": (FORMS["keltner"][0], _sign("close > kc_mid")),
    "TRIX": (FORMS["trix"][0], _sign("trix > trix_signal")),
    "RSI": (FORMS["rsi"][0], _sign("rsi > 50")),
    "Stochastic": (FORMS["stochastic"][0], _sign("stoch_k > stoch_d")),
    "CCI": (FORMS["cci"][0], _sign("cci > 0")),
    "ROC": (FORMS["roc"][0], _sign("roc > 0")),
    "MFI": (FORMS["mfi"][0], _sign("mfi > 50")),
    "Williams_R": (FORMS["williams_r"][0], _sign("williams_r > -50")),
    "CMO": (FORMS["cmo"][0], _sign("cmo > 0")),
    "Stoch_RSI": (FORMS["stoch_rsi"][0], _sign("stoch_rsi_k > stoch_rsi_d")),
    "Ultimate_Oscillator": (FORMS["ultimate"][0], _sign("uo > 50")),
    "TSI": (FORMS["tsi"][0], _sign("tsi > tsi_signal")),
    "Bollinger_Bands": (FORMS["bollinger"][0], _sign("bb_pct_b > 0.5")),
    "ATR_Breakout": (FORMS["atr_breakout"][0], _sign("close > atr_upper", "close < atr_lower")),
    "Keltner_Squeeze": (FORMS["squeeze"][0], _sign("squeeze_mom > 0")),
    "Chaikin_Volatility": ([*FORMS["chaikin"][0], f"coalesce({roll('avg', 'close', 20)}, close) AS sma"], _sign("chaikin_vol > 0 AND close > sma", "chaikin_vol > 0 AND close < sma")),
    "Historical_Volatility": ([f"coalesce({roll('avg', 'close', 20)}, close) AS sma"], _sign("close > sma")),
    "Ulcer_Index": ([*FORMS["ulcer"][0], f"median(ulcer_index) {over(50)} AS med"], _sign("ulcer_index < med")),
    "StdDev_Bands": (FORMS["stddev_bands"][0], _sign("close > stddev_mid")),
    "Choppiness_Index": ([*FORMS["choppiness"][0], EMA20], _sign("chop < 50 AND close > ema_20", "chop < 50 AND close < ema_20")),
    "Mass_Index": ([EMA20], _sign("close < ema_20")),
}


def signal_sql(name: str) -> str | None:
    if name not in SIGNALS:
        return None
    steps, condition = SIGNALS[name]
    return f"{stages(*steps)}SELECT symbol, bar_no, CAST({condition} AS INTEGER) AS signal FROM s{len(steps)}"
