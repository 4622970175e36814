"""Places of regular-expression matches, in code points, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = 256

SPAN = "array<struct<start:int,end:int,s:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(numbers: Column) -> Column:
    """For each element the sum of those before it. In blocks, as arrays grow by copying."""
    zero = F.lit(0)

    def within(block: Column) -> Column:
        start = F.struct(zero.alias("t"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(block, start, lambda acc, x: F.struct((acc.t + x).alias("t"), F.concat(acc.a, F.array(acc.t)).alias("a")))

    def joined(blocks: Column) -> Column:
        start = F.struct(zero.alias("t"), F.array().cast("array<array<int>>").alias("a"))
        step = lambda acc, b: F.struct((acc.t + b.t).alias("t"), F.concat(acc.a, F.array(F.transform(b.a, lambda x: x + acc.t))).alias("a"))
        return F.flatten(F.aggregate(blocks, start, step).a)

    cut = lambda all_: F.transform(F.sequence(zero, F.floor((F.size(all_) - 1) / _STEP).cast("int")), lambda b: F.slice(all_, b * _STEP + 1, _STEP))
    return let(numbers, lambda all_: let(F.transform(cut(all_), within), joined))


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost matches that don't overlap, as structs of start, end (exclusive) and string; none unless ``guard`` holds."""
    empty = F.array().cast(SPAN)

    def placed(v: Column) -> Column:
        sizes = F.zip_with(v.p, v.m, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))
        starts = F.zip_with(sums_before(sizes), v.p, lambda t, a: t + F.length(a))
        found = F.zip_with(starts, v.m, lambda t, s: F.struct(t.alias("start"), (t + F.length(s)).alias("end"), s.alias("s")))
        return F.when(F.size(v.m) == 0, empty).otherwise(F.filter(found, lambda x: x.s.isNotNull()))

    cut = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    return F.when(guard, let(cut, placed)).otherwise(empty)


def written(spans: Column, names: list[str]) -> Column:
    """Sorted structs with ``kind`` (from 0), ``start`` and ``end`` as kind:start:end, joined by commas."""
    name = F.array(*map(F.lit, names))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x.kind), x.start.cast("string"), x.end.cast("string"))))
