"""Operators on sampled signals: rows of (rec_id, idx, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.operators.patterns import before

#: Fixed values of the noise floor, in decibels, and lengths in bins and blocks.
FLOOR_MIN, FLOOR_MAX, MARGIN, CONTRAST, BELOW = -75.0, -40.0, 12.0, 20.0, 15.0
BINS_A_BLOCK, SPAN, LEAST_BINS, LEVEL_BLOCKS = 5, 3, 100, 200


def decibels(power: Column) -> Column:
    return 10 * F.log10(power + F.lit(1e-12))


def percentile_floor(rows: DataFrame, keys: list[str], value: str, q: float, cells: int = 256) -> DataFrame:
    """(keys, value): the value at place floor((n - 1) * q) of a group's sorted values; nulls aside.

    Values are counted in equal cells between the group's least and greatest, and only the cell that holds the place
    is sorted, so no group is gathered as a whole.
    """
    v = rows.where(F.col(value).isNotNull())
    ends = v.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"), F.count("*").alias("__n"))
    cell = F.when(F.col("__b") > F.col("__a"), F.least(F.floor((F.col(value) - F.col("__a")) / (F.col("__b") - F.col("__a")) * cells), F.lit(cells - 1))).otherwise(0)
    placed = v.join(ends, keys).withColumn("__cell", cell)
    counts = placed.groupBy(*keys, "__n", "__cell").agg(F.count("*").alias("__m"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__m").over(before(keys, ["__cell"])), F.lit(0))).withColumn("__at", F.floor((F.col("__n") - 1) * F.lit(q)))
    home = counts.where((F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("__m"))).select(*keys, "__cell", (F.col("__at") - F.col("__before") + 1).alias("__k"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return placed.join(home, [*keys, "__cell"]).withColumn("__r", rank).where(F.col("__r") == F.col("__k")).select(*keys, value)


def waveform_peaks(samples: DataFrame, buckets: int) -> DataFrame:
    """(rec_id, bucket, peak): root mean square of equal stretches, the loudest of a recording being 1."""
    if not 1 <= buckets <= 8000:
        raise ValueError("buckets must be 1 to 8000")
    n = samples.groupBy("rec_id").agg(F.count("*").alias("n"))
    cut = samples.join(n, "rec_id").groupBy("rec_id", F.floor(F.col("idx") * buckets / F.col("n")).alias("bucket")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    top = F.max("rms").over(Window.partitionBy("rec_id"))
    return cut.withColumn("top", top).select("rec_id", "bucket", F.when(F.col("top") > 0, F.round(F.col("rms") / F.col("top"), 3)).otherwise(0.0).alias("peak"))


def rms_envelope(samples: DataFrame, buckets: int) -> DataFrame:
    """(rec_id, bucket, rms): buckets of n / buckets samples, of one at least, so that they share samples where there are few.

    Sample idx lies in bucket i if floor(i n / B) <= idx < max(floor(i n / B) + 1, floor((i + 1) n / B)).
    """
    n = samples.groupBy("rec_id").agg(F.count("*").alias("n"))
    low, high = F.floor(F.col("idx") * buckets / F.col("n")) - 1, F.floor((F.col("idx") + 1) * buckets / F.col("n")) + 1
    met = samples.join(n, "rec_id").withColumn("bucket", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(buckets - 1)))))
    start = F.floor(F.col("bucket") * F.col("n") / buckets)
    end = F.least(F.col("n"), F.greatest(start + 1, F.floor((F.col("bucket") + 1) * F.col("n") / buckets)))
    inside = met.where((F.col("idx") >= start) & (F.col("idx") < end))
    return inside.groupBy("rec_id", "bucket").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def normalise(envelope: DataFrame) -> DataFrame:
    """An envelope whose loudest bucket is 1; a silent one stays."""
    top = F.max("rms").over(Window.partitionBy("rec_id"))
    return envelope.withColumn("rms", F.when(top > 0, F.col("rms") / top).otherwise(F.col("rms")))


def channel(samples: DataFrame, which: int | None = 0) -> DataFrame:
    """One channel of samples (rec_id, channel, idx, v), or with None each as a signal of its own (rec_id, channel)."""
    return samples if which is None else samples.where(F.col("channel") == which).drop("channel")


def downmix(samples: DataFrame) -> DataFrame:
    """The mean of all channels, sample by sample."""
    return samples.groupBy("rec_id", "idx").agg(F.avg("v").alias("v"))


def energy_bins(samples: DataFrame, size: int) -> DataFrame:
    """(rec_id, bin, power): mean power of ``size`` samples; a partial tail is dropped."""
    cut = samples.groupBy("rec_id", F.floor(F.col("idx") / size).alias("bin")).agg(F.avg(F.col("v") * F.col("v")).alias("power"), F.count("*").alias("n"))
    return cut.where(F.col("n") == size).drop("n")


def blocks(bins: DataFrame, size: int = BINS_A_BLOCK) -> DataFrame:
    """(rec_id, block, power): means of ``size`` bins; a partial tail is dropped."""
    cut = bins.groupBy("rec_id", F.floor(F.col("bin") / size).alias("block")).agg(F.avg("power").alias("power"), F.count("*").alias("n"))
    return cut.where(F.col("n") == size).drop("n")


def smoothed(bins: DataFrame) -> DataFrame:
    """Each bin's mean with its neighbours; fewer at the edges."""
    return bins.withColumn("smooth", F.avg("power").over(Window.partitionBy("rec_id").orderBy("bin").rowsBetween(-1, 1)))


def quiet_for(bins: DataFrame, limit_db: float, most: int) -> DataFrame:
    """(rec_id, quiet): how many bins in a row, counted from the end and at most ``most``, are below the limit."""
    loud = F.max(F.when(decibels(F.col("power")) >= limit_db, F.col("bin")))
    return bins.groupBy("rec_id").agg(F.least(F.max("bin") - F.coalesce(loud, F.min("bin") - 1), F.lit(most)).alias("quiet"))


def noise_floor(bins: DataFrame) -> DataFrame:
    """(rec_id, floor_db, limit_db): the quietest three blocks in a row and the loudness below which audio is quiet.

    Both are null where there is under a second of audio or where nothing is quiet enough to be a floor.
    """
    long = bins.groupBy("rec_id").agg((F.count("*") >= LEAST_BINS).alias("enough"))
    order = Window.partitionBy("rec_id").orderBy("block")
    level, back = decibels(F.col("power")), F.count("*").over(Window.partitionBy("rec_id")) - F.col("block")
    b = blocks(bins).withColumn("mean", F.avg("power").over(order.rowsBetween(1 - SPAN, 0))).withColumn("p95", F.when(back <= LEVEL_BLOCKS, level))
    found = b.groupBy("rec_id").agg(F.min(F.when(F.col("block") >= SPAN - 1, decibels(F.col("mean")))).alias("low"))
    found = found.join(percentile_floor(b.select("rec_id", "p95"), ["rec_id"], "p95", 0.95), "rec_id", "left")
    floor = F.greatest("low", F.lit(FLOOR_MIN))
    limit = F.when(F.col("p95") >= F.col("floor_db") + CONTRAST, F.least(F.col("floor_db") + MARGIN, F.col("p95") - BELOW)).otherwise(F.col("floor_db") + MARGIN)
    known = long.join(found, "rec_id", "left").withColumn("floor_db", F.when(F.col("enough") & (floor <= FLOOR_MAX), floor))
    return known.select("rec_id", "floor_db", F.when(F.col("floor_db").isNotNull(), limit).alias("limit_db"))


def separation_quality(pairs: DataFrame) -> DataFrame:
    """(rec_id, si_sdr_db, corr, keep_db, suppress_db) of estimates e against references r, from one pass of sums of products.

    keep_db is the estimate's loudness over the reference's where only the wanted voice speaks (own), suppress_db where only
    others do (mask: a column ``own``, null where both or none speak).
    """
    part = lambda c, own: F.sum(F.when(F.col("own") == own, F.col(c) * F.col(c)))
    sums = pairs.groupBy("rec_id").agg(part("e", True).alias("ek"), part("r", True).alias("rk"), part("e", False).alias("es"), part("r", False).alias("rs"), F.sum(F.col("e") * F.col("r")).alias("er"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("e") * F.col("e")).alias("ee"), F.corr("e", "r").alias("corr"))
    aimed = F.col("er") * F.col("er") / F.col("rr")
    return sums.select("rec_id", (10 * F.log10(aimed / (F.col("ee") - aimed))).alias("si_sdr_db"), "corr", (10 * F.log10(F.col("ek") / F.col("rk"))).alias("keep_db"), (10 * F.log10(F.col("es") / F.col("rs"))).alias("suppress_db"))


def decision_drift(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """How often a decision (over the threshold) differs between reference r and other e, and how clear it was.

    ``agreement`` is the share of frames on which both are over it among those on which either is.
    """
    flip, clear = (F.col("r") > threshold) != (F.col("e") > threshold), F.abs(F.col("r") - threshold)
    near = [F.round(F.count_if(clear <= w) / F.count("*"), 6).alias(f"within_{int(100 * w)}") for w in (0.01, 0.05, 0.10)]
    at = F.when(flip, clear)
    r, e = F.col("r") > threshold, F.col("e") > threshold
    agreement = F.round(F.count_if(r & e) / F.nullif(F.count_if(r | e), F.lit(0)), 6).alias("agreement")
    return pairs.groupBy(*keys).agg(agreement, F.count("*").alias("frames"), F.count_if(flip).alias("flips"), F.min(at).alias("least"), F.percentile(at, F.lit(0.5)).alias("middle"), F.max(at).alias("most"), *near)


def speaker_centroid(pieces: DataFrame, speaker: str, longest: int = 24, least_ms: int = 300) -> DataFrame:
    """(speaker, dim, x): the unit vector along the duration-weighted sum of a speaker's longest pieces."""
    rank = F.row_number().over(Window.partitionBy(speaker).orderBy(F.desc("dur_ms"), "piece"))
    used = pieces.where(F.col("dur_ms") >= least_ms).withColumn("rank", rank).where(F.col("rank") <= longest)
    summed = used.select(speaker, "dur_ms", F.posexplode("embedding").alias("dim", "x")).groupBy(speaker, "dim").agg(F.sum(F.col("x").cast("double") * F.col("dur_ms")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(speaker)))
    return summed.select(speaker, "dim", F.when(norm > 0, F.col("x") / norm).otherwise(0.0).alias("x"))
