"""Column expressions of the row and stream operators; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = 2**64 - 1


def due(iteration: Column, interval: int) -> Column:
    """The sampling filter: every ``interval`` iterations, 0 among them."""
    if interval < 1:
        raise ValueError("a sampling interval is at least 1")
    return iteration % interval == 0


def finite(time: Column) -> Column:
    return time.isNull() | ~(F.isnan(time) | (F.abs(time) == math.inf))


def checked_time(time: Column) -> Column:
    """``time`` itself; a time that isn't finite fails the query."""
    return F.when(finite(time), time).otherwise(F.raise_error(F.lit("non_finite_physical_time")))


def advanced_iteration(iteration: Column) -> Column:
    """One more; at the end of unsigned 64-bit numbers the query fails."""
    wide = iteration.cast("decimal(20,0)")
    return F.when(wide < F.lit(str(U64_MAX)).cast("decimal(20,0)"), (wide + 1).cast("decimal(20,0)")).otherwise(F.raise_error(F.lit("iteration_overflow")))


def advanced_time(time: Column, delta: Column | None) -> Column:
    """``time + delta``: both must be there and finite, as must the sum. Without a delta the time stays."""
    if delta is None:
        return checked_time(time)
    total = time + delta
    good = time.isNotNull() & delta.isNotNull() & finite(delta) & finite(total)
    return F.when(good, total).otherwise(F.raise_error(F.lit("invalid_time_advance")))


def seconds_since(stamp: Column, start: str) -> Column:
    """Seconds of a timestamp since ``start``, both read as UTC."""
    micros = F.unix_micros(stamp.cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))
    return micros / 1_000_000.0


def record_line(iteration: Column, time: Column | None, values: list[Column]) -> Column:
    """One record as a JSON line without its line feed. ``values`` are JSON texts; a null one (an empty slot) fails the query."""
    slots = [F.coalesce(v, F.raise_error(F.lit("missing_payload")).cast("string")) for v in values]
    body = F.concat(F.lit('"values":['), F.concat_ws(",", *slots), F.lit("]}"))
    when = F.lit("") if time is None else F.when(time.isNull(), F.lit("")).otherwise(F.concat(F.lit('"physical_time":'), F.to_json(F.struct(checked_time(time).alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(time.alias("t")))) - 6), F.lit(",")))
    return F.concat(F.lit('{"iteration":'), iteration.cast("string"), F.lit(","), when, body)


def json_text(value: Column, kind: str) -> Column:
    """A payload column of the DDL type ``kind`` as JSON text; null for an empty slot."""
    if kind == "json":  # is text already
        return value
    packed = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(packed.substr(F.lit(6), F.length(packed) - 6))


def leads_to(a: Column, b: Column) -> Column:
    """Array ``a`` of segments is a proper prefix of ``b``."""
    return (F.size(a) < F.size(b)) & (F.slice(b, 1, F.size(a)) == a)


def paths_conflict(a: Column, b: Column) -> Column:
    return (a == b) | leads_to(a, b) | leads_to(b, a)


def segments(pointer: Column) -> Column:
    """Segments of a valid JSON Pointer."""
    return F.transform(F.slice(F.split(pointer, "/"), 2, 1_000_000), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
