"""All queries of the market-data part, by name."""

from . import catalogue_queries, more_queries, parametric_queries, stream_queries, tick_queries  # noqa: F401  the others register themselves


def queries() -> dict:
    return dict(tick_queries.QUERIES)


def oracles() -> dict:
    return dict(tick_queries.ORACLES)
