"""Compiles a Filter to one Column, so that Catalyst pushes it to the scan."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog.functions.labels import any_of, like_pattern
from weirlog.model import BOOLEANS, NUMBERS, Filter, column_of, truth, view


def _values(dimension: str, values: list[str]) -> list:
    """Values in the column's type; numbers that can't be read match nothing."""
    if dimension in BOOLEANS:
        return sorted({int(truth(v)) for v in values})
    if dimension in NUMBERS:
        return sorted({int(v) for v in values if v.strip().lstrip("+-").isdigit()})
    return list(dict.fromkeys(values))


def condition(flt: Filter) -> Column | None:
    """None where nothing is filtered; an include of which nothing can be read is false, such an exclude true."""
    tests: list[Column] = []
    for dimension, values in flt.include.items():
        name = column_of(dimension)
        if values:
            found = _values(dimension, values)
            tests.append(F.col(name).isin(found) if found else F.lit(False))
    for dimension, values in flt.exclude.items():
        name = column_of(dimension)
        if values and (found := _values(dimension, values)):
            tests.append(~F.col(name).isin(found))
    for dimension, values in flt.contains.items():
        name = column_of(dimension)
        if values:
            tests.append(any_of([F.col(name).cast("string").ilike(like_pattern(v)) for v in values]))
    if flt.time_from is not None:
        tests.append(F.col("ts") >= F.lit(flt.time_from))
    if flt.time_to is not None:
        tests.append(F.col("ts") < F.lit(flt.time_to))
    return reduce(lambda a, b: a & b, tests) if tests else None


def _date(ns: int) -> Column:
    return F.lit(datetime.fromtimestamp(ns // 1_000_000_000, UTC).date())


def apply(rows: DataFrame, flt: Filter) -> DataFrame:
    """Rows that pass; where they come by day, a time window reads its days only."""
    found = condition(flt)
    if "day" in rows.columns:
        rows = rows.where(F.col("day") >= _date(flt.time_from)) if flt.time_from is not None else rows
        rows = rows.where(F.col("day") <= _date(flt.time_to)) if flt.time_to is not None else rows
    return rows if found is None else rows.where(found)


def last_days(rows: DataFrame, days: float) -> DataFrame:
    """Rows of the last so many days before the newest one; zero days are no limit. The newest time is one row, joined."""
    if days <= 0:
        return rows
    since = rows.agg((F.max("ts") - F.lit(round(days * 86_400 * 1_000_000_000))).alias("_since"))
    return rows.join(F.broadcast(since), F.col("ts") >= F.col("_since")).drop("_since")


def matches_view(name: str, flt: Filter) -> Column:
    """Whether a row, also one of a live batch, is shown by a view under a filter: the view's pool, its filter, the defaults."""
    pool, extra = view(name)
    found = condition(flt.merge(extra).with_defaults(pool))
    return (F.col("pool") == pool) & (F.lit(True) if found is None else found)
