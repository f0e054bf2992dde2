"""Plan shapes that several operators share: running values, islands, range joins and as-of joins.

All windows are partitioned by the caller's keys (usually the recording), so one exchange by those keys
serves a whole chain of operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def before(keys: list[str], order: list) -> WindowSpec:
    """All earlier rows of the key."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def up_to(keys: list[str], order: list) -> WindowSpec:
    """All earlier rows of the key and this one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def islands(df: DataFrame, keys: list[str], order: list, opens: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows: a row where ``opens`` holds begins a new run (numbers from 0 or 1 by the first row)."""
    return df.withColumn("__opens", F.coalesce(opens.cast("int"), F.lit(0))).withColumn(name, F.sum("__opens").over(up_to(keys, order))).drop("__opens")


def range_join(left: DataFrame, right: DataFrame, key: str, width: int, left_on: tuple[str, str], right_on: tuple[str, str]) -> DataFrame:
    """Pairs of the same key whose intervals overlap by more than nothing.

    Both sides are dealt into time cells of ``width`` and joined on (key, cell); a pair is kept in the cell of
    the later start alone, so it comes once. A long recording is thus spread over many tasks. A side without
    cells costs ceil(length / width) rows an interval: choose a width near the usual length.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b) - 1) / width)))
    (ls, le), (rs, re) = left_on, right_on
    pairs = left.withColumn("__cell", cells(ls, le)).join(right.withColumn("__cell", cells(rs, re)), [key, "__cell"])
    later = F.greatest(F.col(ls), F.col(rs))
    return pairs.where((F.floor(later / width) == F.col("__cell")) & (F.least(F.col(le), F.col(re)) > later)).drop("__cell")


def asof_last(events: DataFrame, asked: DataFrame, key: str | list[str], event_at: str, asked_at: str, payload: list[str], tie: str) -> DataFrame:
    """For each asked time the last event at or before it (by time, then ``tie``): a union and one window."""
    keys, value = [key] if isinstance(key, str) else key, F.struct(*payload)
    e = events.select(*keys, F.col(event_at).alias("__at"), F.lit(0).alias("__kind"), F.col(tie).cast("long").alias("__tie"), value.alias("__value"))
    extra = [c for c in asked.columns if c not in keys]
    e = e.select("*", *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in extra))
    a = asked.select(*keys, F.col(asked_at).alias("__at"), F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__tie"), F.lit(None).cast(e.schema["__value"].dataType).alias("__value"), *extra)
    found = F.last("__value", ignorenulls=True).over(up_to(keys, ["__at", "__kind", "__tie"]))
    return e.unionByName(a).withColumn("__found", found).where("__kind = 1").select(*keys, *extra, *(F.col("__found")[p].alias(p) for p in payload))


def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right`` by ``keys``, null where it has none: a union and one grouping.

    Each side has a row a key at most. Sides that are dealt alike by some of the keys (the recording) meet without an exchange, which
    a join by all of them would ask for.
    """
    sides = [F.struct(*(c for c in df.columns if c not in keys)) for df in (left, right)]
    kinds = [df.select(s.alias("s")).schema["s"].dataType for df, s in zip((left, right), sides, strict=True)]
    one = left.select(*keys, sides[0].alias("__l"), F.lit(None).cast(kinds[1]).alias("__r"))
    both = one.unionByName(right.select(*keys, F.lit(None).cast(kinds[0]).alias("__l"), sides[1].alias("__r")))
    met = both.groupBy(*keys).agg(F.first("__l", ignorenulls=True).alias("__l"), F.first("__r", ignorenulls=True).alias("__r"))
    return met.where("__l IS NOT NULL").select(*keys, "__l.*", "__r.*")


def first_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark prunes groups before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")
