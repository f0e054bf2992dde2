"""Sharding: the minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewords.llm.common import read, settle

#: Hex digits of text hashes that name the first ranges, and by how many a range is cut finer where a shard may end in it.
RANGE_DIGITS, MORE_DIGITS = 4, 2
#: Rows of a range that are ranked in one cell, about.
CELL_ROWS = 1 << 9


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity for which greedy filling puts the ordered ``sizes`` into at most ``shards`` runs."""
    ends = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    low, high = max(int(sizes.max(initial=0)), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        capacity = (low + high) // 2
        at = 0
        for _ in range(shards):
            at = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        low, high = (low, capacity) if at == len(sizes) else (capacity + 1, high)
    return low


def cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """The first group of each shard but the first, none of them above the smallest feasible capacity.

    Many partitions reach that capacity when one group is large; among them each shard takes what is left
    divided by the shards left, as far as the capacity allows and the rest still fits.
    """
    capacity = smallest_capacity(sizes, shards)
    ends = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    least = [len(sizes)]  # from the back: the earliest start that the shards behind can still take
    for _ in range(shards - 1):
        least.append(int(np.searchsorted(ends, ends[least[-1]] - capacity, "left")))
    out, at = [], 0
    for k in range(1, shards):
        fair = ends[at] + (ends[-1] - ends[at]) / (shards - k + 1)
        near = int(np.searchsorted(ends, fair, "left"))
        near -= near > at and fair - ends[near - 1] < ends[min(near, len(sizes))] - fair
        most = int(np.searchsorted(ends, ends[at] + capacity, "right")) - 1
        at = min(max(near, least[shards - k], at), most)
        out.append(at)
    return out


def furthest(ends: np.ndarray, single: np.ndarray, capacity: int, shards: int, split: bool) -> list[int]:
    """The places (group indices) that greedy filling reaches, shard by shard.

    With ``split`` a range of several groups may be cut at any byte, which no real cut can better; the place is then
    the range that holds the cut. Without, ranges are filled whole.
    """
    places, at, spare = [], 0, 0.0
    for _ in range(shards):
        goal = ends[at] + spare + capacity
        at = int(np.searchsorted(ends, goal, "right")) - 1
        spare = float(goal - ends[at]) if split and at < len(single) and not single[at] else 0.0
        places.append(at)
    return places


def exact_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Hashes at which each shard but the first begins, and the smallest feasible capacity over single groups.

    ``groups`` has a row (hash, n, b) a group. Sizes are summed by ranges of hashes. Filling whole ranges gives a
    capacity that can be reached; cutting ranges at any byte gives one that can't be bettered. While they differ, the
    ranges in which a shard may end at any capacity between the two are cut finer. The driver sees 65,536 ranges and
    256 more for each that is cut, whatever the input.
    """
    def ranges(rows: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        summed = rows.groupBy(F.substring("hash", 1, digits).alias("range")).agg(F.count("*").alias("k"), F.sum("b").alias("b"))
        return [(r["range"], r["k"], int(r["b"])) for r in summed.collect()]

    table = {name: (k, b) for name, k, b in ranges(groups, RANGE_DIGITS)}
    while table:
        names = sorted(table)
        sizes, single = np.array([table[x][1] for x in names], np.int64), np.array([table[x][0] == 1 for x in names])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        high, low = smallest_capacity(sizes, shards), -(-int(ends[-1]) // shards)
        top = high
        while low < top:
            middle = (low + top) // 2
            done = furthest(ends, single, middle, shards, split=True)[-1] >= len(names)
            low, top = (low, middle) if done else (middle + 1, top)
        if low == high:
            return [names[k] if k < len(names) else "g" for k in cuts(sizes, shards)], high
        near, far = furthest(ends, single, low, shards, split=False), furthest(ends, single, high, shards, split=True)
        finer = {names[k] for a, b in zip(near, far, strict=True) for k in range(a, min(b + 1, len(names))) if not single[k]}
        for digits in sorted(set(map(len, finer))):
            some = [x for x in finer if len(x) == digits]
            table = {x: v for x, v in table.items() if x not in some}
            for name, k, b in ranges(groups.where(F.substring("hash", 1, digits).isin(some)), digits + MORE_DIGITS):
                table[name] = k, b
    return [], 0


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs`` with size, shard and slot under the law ``bytes``: equal texts together, sizes near equal.

    Groups of equal texts, in order of their MD5, are the atomic groups; the smallest feasible capacity is found over
    them (``exact_cuts``). Slots count up inside a shard by hash range, cell and hash; a range of many rows, as a
    group of copies, is ranked in as many cells as its size asks for.

    Null and empty texts have size 8 and form one group; repeated rows get a slot each (rows alike in id and text are
    ranked in one cell); a null id sorts first, ids may be of any type; an empty table gives no rows. Columns of
    ``docs`` named like the added ones are replaced, any others kept.
    """
    base = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"),
        F.struct(*(c for c in docs.columns if c not in ("size", "shard", "slot"))).alias("row"),
    ).withColumn("size", F.col("size") + 8)
    groups = settle(base.groupBy("hash").agg(F.count("*").alias("n"), F.sum("size").alias("b")))
    begins = exact_cuts(groups, shards)[0]
    shard = lambda h: sum((F.when(h >= b, 1).otherwise(0) for b in begins), F.lit(0)).cast("int")
    wide = groups.groupBy(F.substring("hash", 1, RANGE_DIGITS).alias("range")).agg(F.ceil(F.sum("n") / CELL_ROWS).alias("cells"))
    placed = base.withColumn("range", F.substring("hash", 1, RANGE_DIGITS)).join(F.broadcast(wide), "range")  # at most 65,536 rows
    placed = placed.withColumn("shard", shard(F.col("hash"))).withColumn("cell", F.pmod(F.xxhash64("doc_id", "hash"), "cells"))
    keys = ["shard", "range", "cell"]
    counted = placed.groupBy(*keys).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("range", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(*keys, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "doc_id"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "shard", "slot")]
    return placed.join(offsets, keys).select(*kept, "size", "shard", (F.col("before") + rank - 1).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards; see ``shard_documents`` for nulls, empty texts and repeated rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
