"""Shared pieces of the DuckDB forms of the queries: ticks, series of bars, exponential means."""

TICKS = """t AS (
  SELECT ts, event_id AS seq, event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume, CAST(ts AS DATE) AS trade_date
  FROM events)"""

BAR = """min(ts) AS open_time, max(ts) AS close_time, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, count(*) AS tick_count,
  CASE WHEN sum(volume) > 0 THEN sum(price * volume) / sum(volume) ELSE last(price ORDER BY ts, seq) END AS vwap"""

#: Bars of 20 ticks per symbol and day; i counts a symbol's bars.
SERIES = f"""{TICKS},
n AS (SELECT *, (row_number() OVER (PARTITION BY symbol, trade_date ORDER BY ts, seq) - 1) // 20 AS bar_idx FROM t),
b AS (SELECT symbol, trade_date, bar_idx, {BAR} FROM n GROUP BY symbol, trade_date, bar_idx),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date, bar_idx) - 1 AS bar_no FROM b)"""

W = "(PARTITION BY symbol ORDER BY bar_no)"


def over(n: int, back: int = 0) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {n - 1 + back} PRECEDING AND {f'{back} PRECEDING' if back else 'CURRENT ROW'})"


def roll(fn: str, x: str, n: int) -> str:
    """fn over n rows, null until all have a value."""
    return f"CASE WHEN count({x}) {over(n)} >= {n} THEN {fn}({x}) {over(n)} END"


def ewm(x: str, alpha: float) -> str:
    """Exponential mean from the first value on (leading nulls are skipped)."""
    return f"CASE WHEN {x} IS NOT NULL THEN list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING), lambda a, v: {1 - alpha!r} * a + {alpha!r} * v) END"


def span(x: str, n: int) -> str:
    return ewm(x, 2 / (n + 1))


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {W}"


def stages(*columns: str, base: str = "bars") -> str:
    """CTEs s1, s2, ... that add the given columns one after another."""
    out, last = [SERIES], base
    for i, c in enumerate(columns, 1):
        out.append(f"s{i} AS (SELECT *, {c} FROM {last})")
        last = f"s{i}"
    return "WITH " + ",\n".join(out) + "\n"


def rounded(columns: str, exact: str = "") -> str:
    return ", ".join(["symbol", "bar_no", *exact.split(), *(f"round({c}, 6) AS {c}" for c in columns.split())])
