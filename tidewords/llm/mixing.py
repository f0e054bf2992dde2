"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewords.llm.common import WORD, read, settle

SEED = "mix-1"
#: Columns that the mix adds.
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """The size with all but its seven leading bits cleared: a monotone class about 1.5 % wide."""
    shift = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Targets in words of the rows (__src, __nosrc, source_size), one row a source.

    Weights repeat over the sources by code point, null last. A target stops at ``max_repeat`` times its
    source; the excess goes to the others by weight until none is above. In order of (limit / weight) the
    stopped sources come first, so running sums find them without a loop. The two windows see one row a source.
    """
    ordered, whole = Window.orderBy("__nosrc", "__src"), Window.partitionBy()
    by_ratio = Window.orderBy(F.col("limit") / F.col("w"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sizes.withColumn("pos", F.row_number().over(ordered) - 1)
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("limit", (max_repeat * F.col("source_size")).cast("double"))
        .withColumn("all", F.sum("source_size").over(whole).cast("double"))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
        .withColumn("stopped", F.col("limit") * F.col("w_left") < F.col("w") * F.col("left"))
    )
    free = lambda c: F.coalesce(F.sum(F.when(F.col("stopped"), F.col(c))).over(whole), F.lit(0.0))
    level = (F.col("all") - free("limit")) / F.nullif(F.sum("w").over(whole) - free("w"), F.lit(0.0))
    return rows.withColumn("target", F.when(F.col("stopped"), F.col("limit")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("w"))).select("__src", "__nosrc", "source_size", "target")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken: how often the mix takes each document.

    Within a source each document expects target / source_size copies. In order of size class, then a hash
    of the id, a document's rank times that rate is the prefix sum of expected copies; one random offset a
    source is added, and the document is taken once for each integer crossed. Ranks come from counts of
    (source, class, hash cell) and a window inside each cell, so no window ever holds a whole source.

    Null and empty texts have size 0 and may be taken without adding words; a null source is a source of its
    own, last in order; repeated rows are rows like any other (ties in order by size and text hash); null ids are
    told apart by their texts; ids may be of any type; an empty table gives no rows. Columns of ``docs`` named like
    the added ones are replaced, any others kept.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("print"), F.struct(*kept).alias("row"))
    return place(rows, weights, max_repeat, seed).select(*(F.col("row")[c].alias(c) for c in kept), *ADDED)


def place(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, size, print of the text, row) with source_size, target, copies and taken."""
    keys = ["__src", "__nosrc", "__class", "__cell"]
    base = (
        rows.withColumn("__src", F.coalesce("source", F.lit("")))
        .withColumn("__nosrc", F.col("source").isNull())
        .withColumn("__class", size_class(F.col("size")))
        .withColumn("__hash", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), "print"))).cast("binary")))
        .withColumn("__cell", F.substring("__hash", 1, 2))
    )
    cells = base.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    classes = cells.groupBy(*keys[:3]).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    totals = classes.groupBy(*keys[:2]).agg(F.sum("s").alias("source_size"))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select(*keys[:3], before(keys[:2], "__class").alias("before_class")).join(source_targets(totals, weights, max_repeat), keys[:2])
    cells = cells.select(*keys, before(keys[:3], "__cell").alias("before_cell")).join(classes, keys[:3])
    rank = F.col("before_class") + F.col("before_cell") + F.row_number().over(Window.partitionBy(*keys).orderBy("__hash", "size", "print"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "__nosrc", "__src").cast("binary")), 1, 6), 16, 10).cast("double") / float(1 << 24)
    crossed = lambda at: F.floor(at * F.col("__rate") + F.col("__offset"))
    return (
        base.join(cells, keys)
        .withColumns({"__rank": rank, "__rate": rate, "__offset": offset})
        .withColumn("copies", F.least(crossed(F.col("__rank")) - crossed(F.col("__rank") - 1), F.lit(max_repeat)).cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; see ``mix_sources`` for nulls, ties and repeated rows. Words are counted once."""
    docs = read(spark, sf_dir, "documents")
    print_ = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).otherwise(F.xxhash64("text").cast("string")).alias("print")
    rows = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), print_))
    return place(rows).select("doc_id", *ADDED)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document, with all its columns, as many times as it is taken; those taken no time go."""
    held = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))  # so that no name clashes
    mixed = mix_sources(held).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


OP4_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS nosrc,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS h
  FROM documents),
sources AS (SELECT src, nosrc, sum(size)::DOUBLE AS ss FROM base GROUP BY ALL),
placed AS (SELECT *, (row_number() OVER (ORDER BY nosrc, src) - 1) % 3 + 1.0::DOUBLE AS w, row_number() OVER (ORDER BY nosrc, src) AS pos FROM sources),
filled AS (
  SELECT *, 3 * ss AS lim, sum(ss) OVER () AS total,
    sum(ss) OVER () - coalesce(sum(3 * ss) OVER r, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS w_rest
  FROM placed WINDOW r AS (ORDER BY 3 * ss / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, lim * w_rest < w * rest AS stopped FROM filled),
targets AS (
  SELECT src, nosrc, ss, CASE WHEN stopped THEN lim ELSE coalesce((total - coalesce(sum(lim) FILTER (stopped) OVER (), 0))
    / nullif(sum(w) OVER () - coalesce(sum(w) FILTER (stopped) OVER (), 0), 0), 0) * w END AS target
  FROM marked),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src, nosrc
    ORDER BY (size >> greatest(length(bin(size)) - 7, 0)) << greatest(length(bin(size)) - 7, 0), h, size) AS i
  FROM base JOIN targets USING (src, nosrc)),
steps AS (
  SELECT *, CASE WHEN ss > 0 THEN target / ss ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || CAST(nosrc AS VARCHAR) || ':' || src), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u
  FROM ranked)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target,
  CAST(least(floor(i * rate + u) - floor((i - 1) * rate + u), 3) AS BIGINT) AS copies,
  size * CAST(least(floor(i * rate + u) - floor((i - 1) * rate + u), 3) AS BIGINT) AS taken
FROM steps
"""
