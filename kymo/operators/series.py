"""Ordered series: rows of one schema with strictly rising iterations, per series key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.errors import SeriesError


def _order(keys: Sequence[str], by: str = "iteration") -> Window:
    return Window.partitionBy(*keys).orderBy(by)


def order_violations(df: DataFrame, keys: Sequence[str], arrival: Sequence[str | Column], iteration: str = "iteration") -> DataFrame:
    """Rows, in order of ``arrival``, whose iteration isn't above the one before; with previous_iteration."""
    w = Window.partitionBy(*keys).orderBy(*arrival)
    return df.withColumn("previous_iteration", F.lag(iteration).over(w)).filter(F.col(iteration) <= F.col("previous_iteration"))


def append(series: DataFrame, more: DataFrame, keys: Sequence[str] = (), iteration: str = "iteration") -> DataFrame:
    """``series`` with ``more`` behind it. Another schema, or an iteration that isn't above the series' last or isn't
    unique in ``more``, is an error that carries the rejected rows."""
    shape = lambda d: [(f.name, f.dataType) for f in d.schema]
    if shape(series) != shape(more):
        raise SeriesError("schema_mismatch", "the rows have another schema", more)
    last = F.max(iteration).alias("_last")
    if keys:
        joined = more.join(series.groupBy(*keys).agg(last), list(keys), "left")
    else:
        joined = more.withColumn("_last", F.lit(series.agg(last).first()["_last"]))
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys, iteration)) > 1
    bad = joined.withColumn("_twice", twice).filter((F.col(iteration) <= F.col("_last")) | F.col("_twice")).drop("_last", "_twice")
    if not bad.isEmpty():
        raise SeriesError("non_increasing_iteration", "an iteration isn't above the series' last", bad)
    return series.unionByName(more)


def without_last(df: DataFrame, keys: Sequence[str] = (), iteration: str = "iteration") -> DataFrame:
    return df.withColumn("_last", F.max(iteration).over(Window.partitionBy(*keys))).filter(F.col(iteration) < F.col("_last")).drop("_last")


def with_position(df: DataFrame, keys: Sequence[str] = (), iteration: str = "iteration") -> DataFrame:
    """Positions count from 0 in order of iteration."""
    return df.withColumn("position", (F.row_number().over(_order(keys, iteration)) - 1).cast("bigint"))


def state_at(df: DataFrame, position: int, keys: Sequence[str] = (), iteration: str = "iteration") -> DataFrame:
    return with_position(df, keys, iteration).filter(F.col("position") == position)


def replace_at(df: DataFrame, position: int, field: str, value: Column, keys: Sequence[str] = (), iteration: str = "iteration") -> DataFrame:
    """One field of the row at one position changed."""
    return with_position(df, keys, iteration).withColumn(field, F.when(F.col("position") == position, value).otherwise(F.col(field))).drop("position")


def first_state(df: DataFrame, keys: Sequence[str], iteration: str = "iteration") -> DataFrame:
    return _end(df, keys, iteration, F.min_by)


def latest_state(df: DataFrame, keys: Sequence[str], iteration: str = "iteration") -> DataFrame:
    """The row of the highest iteration per key: one aggregation, combined before the shuffle; no window over the series."""
    return _end(df, keys, iteration, F.max_by)


def _end(df: DataFrame, keys: Sequence[str], iteration: str, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(iteration)).alias("_row")).select(*keys, "_row.*")


def cleared(df: DataFrame) -> DataFrame:
    """The series without its rows; the schema stays."""
    return df.filter(F.lit(False))


def ordered(df: DataFrame, keys: Sequence[str] = (), iteration: str = "iteration") -> DataFrame:
    """Rows of each series in order of iteration."""
    return df.orderBy(*keys, iteration)


def iterations(df: DataFrame, keys: Sequence[str] = (), iteration: str = "iteration") -> DataFrame:
    """(keys, iteration), in order."""
    return ordered(df.select(*keys, iteration), keys, iteration)


def lengths(df: DataFrame, keys: Sequence[str] = (), iteration: str = "iteration") -> DataFrame:
    """(keys, length, first_iteration, last_iteration): one aggregation, combined before its shuffle. No row for an empty series."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"), F.min(iteration).alias("first_iteration"), F.max(iteration).alias("last_iteration"))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def view(df: DataFrame, name: str) -> str:
    """The series under a name for SQL, read only and without a copy."""
    df.createOrReplaceTempView(name)
    return name
