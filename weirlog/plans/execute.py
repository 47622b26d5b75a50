"""A Query to a DataFrame; nothing runs but the span of an open timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.model import POOLS, Kind, Query, column_of
from weirlog.operators import aggregates, filters


def pool_of(rows: DataFrame, pool: str) -> DataFrame:
    if pool not in POOLS:
        raise ValueError(f"unknown pool {pool!r}")
    return rows.where(F.col("pool") == pool)


def execute(rows: DataFrame, query: Query, now: int | None = None) -> DataFrame:
    found = filters.apply(pool_of(rows, query.pool), query.filter)
    if query.kind == Kind.OVERVIEW:
        return aggregates.overview(found)
    if query.kind == Kind.STATUS_CLASS:
        return aggregates.status_classes(found)
    if query.kind == Kind.TOPN:
        return aggregates.topn(found, column_of(query.group_by), query.limit, query.offset, query.order_by)
    if query.kind == Kind.TIMELINE:
        return aggregates.timeline(found, query.filter, query.bucket, now)
    return aggregates.latest(found, query.limit, query.offset, query.order_by)
