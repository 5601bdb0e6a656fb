"""Ordered per-key columns that survive a key holding a large part of the table.

A plain ``Window.partitionBy(session)`` sends a whole session to one task.  Here
each key is cut into buckets of its order (a day of events, a block of lines):
the window runs inside (key, bucket), one summary row per bucket carries the
state over to later buckets, and only those summaries are windowed per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Carry:
    """One output column: ``kind`` is lag, sum, max or last.

    lag   value of the row before; sum   running sum up to and with the row;
    max   running maximum before the row; last  last non-null value before the
    row (``inclusive=True``: up to and with the row, for max and last).
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = False


def lag(name: str, value: Column) -> Carry:
    return Carry(name, "lag", value)


def running_sum(name: str, value: Column) -> Carry:
    return Carry(name, "sum", value, True)


def running_max(name: str, value: Column, inclusive: bool = False) -> Carry:
    return Carry(name, "max", value, inclusive)


def last_value(name: str, value: Column, inclusive: bool = False) -> Carry:
    return Carry(name, "last", value, inclusive)


def day_bucket(ts: str = "ts") -> Column:
    return F.date_trunc("day", F.col(ts))


def with_carried(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[Carry],
    bucket: Column,
    descending: bool = False,
) -> DataFrame:
    """Add ``columns`` to ``df``; ``bucket`` must not decrease along ``order``."""
    src = [f"__v{i}" for i in range(len(columns))]
    df = df.withColumns({"__b": bucket, **{s: c.value for s, c in zip(src, columns, strict=True)}})
    direction = (lambda c: F.col(c).desc()) if descending else F.col
    inside = W.partitionBy(*keys, "__b").orderBy(*[direction(c) for c in order])
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)

    aggs, local = [], {}
    at = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if descending else F.max_by
    for i, (s, c) in enumerate(zip(src, columns, strict=True)):
        v = F.col(s)
        if c.kind == "lag":
            local[f"__l{i}"] = F.lag(F.struct(v.alias("v"))).over(inside)
            aggs.append(pick(F.struct(v.alias("v")), at).alias(f"__s{i}"))
        elif c.kind == "sum":
            local[f"__l{i}"] = F.sum(v).over(upto)
            aggs.append(F.sum(v).alias(f"__s{i}"))
        elif c.kind == "max":
            local[f"__l{i}"] = F.max(v).over(upto if c.inclusive else before)
            aggs.append(F.max(v).alias(f"__s{i}"))
        else:
            local[f"__l{i}"] = F.last(v, ignorenulls=True).over(upto if c.inclusive else before)
            aggs.append(pick(v, F.when(v.isNotNull(), at)).alias(f"__s{i}"))

    earlier = W.partitionBy(*keys).orderBy(direction("__b")).rowsBetween(W.unboundedPreceding, -1)
    across = {}
    for i, c in enumerate(columns):
        s = F.col(f"__s{i}")
        across[f"__s{i}"] = {
            "lag": lambda s=s: F.last(s, ignorenulls=True).over(earlier),
            "sum": lambda s=s: F.sum(s).over(earlier),
            "max": lambda s=s: F.max(s).over(earlier),
            "last": lambda s=s: F.last(s, ignorenulls=True).over(earlier),
        }[c.kind]()
    summary = df.groupBy(*keys, "__b").agg(*aggs)
    summary = summary.select(*keys, "__b", *[e.alias(n) for n, e in across.items()])

    out = df.withColumns(local).join(summary, [*keys, "__b"], "left")
    done = {}
    for i, c in enumerate(columns):
        here, carried = F.col(f"__l{i}"), F.col(f"__s{i}")
        if c.kind == "lag":
            done[c.name] = F.coalesce(here, carried)["v"]
        elif c.kind == "sum":
            done[c.name] = F.when(
                here.isNotNull() | carried.isNotNull(),
                F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)),
            )
        elif c.kind == "max":
            done[c.name] = F.greatest(here, carried)
        else:
            done[c.name] = F.coalesce(here, carried)
    helpers = ["__b", *src, *[f"__l{i}" for i in range(len(columns))], *[f"__s{i}" for i in range(len(columns))]]
    return out.withColumns(done).drop(*helpers)
