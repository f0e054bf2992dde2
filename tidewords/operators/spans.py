"""Interval algebra over (rec_id, s, e) spans; units are the caller's, whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewords.operators.patterns import before, islands, range_join


def merge_spans(spans: DataFrame, gap: int = 0) -> DataFrame:
    """Spans of a recording joined where they overlap, touch or lie closer than ``gap``; empty spans are skipped."""
    order = ["s", "e"]
    s = spans.where("e > s").withColumn("__reach", F.max("e").over(before(["rec_id"], order)))
    apart = F.col("__reach").isNull() | ((F.col("s") > F.col("__reach")) if gap == 0 else (F.col("s") - F.col("__reach") >= gap))
    return islands(s, ["rec_id"], order, apart).groupBy("rec_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def silences(spans: DataFrame, totals: DataFrame, least: int = 300) -> DataFrame:
    """Gaps of at least ``least`` before, between and after a recording's spans; totals: (rec_id, total)."""
    rows = spans.select("rec_id", "s", "e").unionByName(totals.select("rec_id", F.col("total").alias("s"), F.col("total").alias("e")))
    cursor = F.greatest(F.coalesce(F.max("e").over(before(["rec_id"], ["s", "e"])), F.lit(0)), F.lit(0))
    return rows.withColumn("start_ms", cursor).where(F.col("s") - F.col("start_ms") >= least).select("rec_id", "start_ms", F.col("s").alias("end_ms"))


def transcript_silences(segments: DataFrame, totals: DataFrame) -> DataFrame:
    """Every gap of a transcript, and the share of its duration that segments cover (two decimals, at most 1)."""
    spans = segments.select("rec_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    gaps = silences(spans, totals, 1)
    covered = merge_spans(spans).groupBy("rec_id").agg(F.sum(F.col("e") - F.col("s")).alias("speech"))
    ratio = F.round(F.least(F.lit(1.0), F.coalesce("speech", F.lit(0)) / F.col("total")), 2)
    share = totals.join(covered, "rec_id", "left").select("rec_id", F.when(F.col("total") > 0, ratio).otherwise(0.0).alias("speech_ratio"))
    return gaps.join(share, "rec_id")


def subtract_spans(a: DataFrame, b: DataFrame, width: int = 5000) -> DataFrame:
    """What is left of each span of ``a`` outside the spans of ``b``, as (rec_id, s, e)."""
    a = merge_spans(a).withColumnRenamed("s", "as").withColumnRenamed("e", "ae")
    b = merge_spans(b).select("rec_id", F.col("s").alias("bs"), F.col("e").alias("be"))
    cuts = range_join(a, b, "rec_id", width, ("as", "ae"), ("bs", "be")).select("rec_id", "as", "ae", F.col("bs").alias("s"), F.col("be").alias("e"))
    ends = a.select("rec_id", "as", "ae", F.col("ae").alias("s"), F.col("ae").alias("e"))
    cursor = F.greatest(F.col("as"), F.coalesce(F.max("e").over(before(["rec_id", "as"], ["s", "e"])), F.col("as")))
    return cuts.unionByName(ends).withColumn("from", cursor).where("s > from").select("rec_id", F.col("from").alias("s"), F.col("s").alias("e"))


def clip_spans(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """Spans cut to 0..total."""
    return spans.join(totals, "rec_id").select("rec_id", F.greatest(F.lit(0), "s").alias("s"), F.least("total", "e").alias("e"))


def coverage(windows: DataFrame, spans: DataFrame, width: int = 5000) -> DataFrame:
    """windows (rec_id, ws, we) with ``covered``: the summed overlap with the spans."""
    hit = range_join(windows, spans.select("rec_id", "s", "e"), "rec_id", width, ("ws", "we"), ("s", "e"))
    sums = hit.groupBy("rec_id", "ws", "we").agg(F.sum(F.least("we", "e") - F.greatest("ws", "s")).alias("covered"))
    return windows.join(sums, ["rec_id", "ws", "we"], "left").select("rec_id", "ws", "we", F.coalesce("covered", F.lit(0)).alias("covered"))


def isolation_regions(keep: DataFrame, totals: DataFrame, gap: int = 500, lead: int = 500) -> DataFrame:
    """0..total cut at the edges of the kept spans (those closer than ``gap`` as one); each region is fed ``lead`` earlier."""
    kept = clip_spans(merge_spans(keep, gap), totals)
    edges = kept.select("rec_id", F.explode(F.array("s", "e")).alias("s")).unionByName(totals.select("rec_id", F.explode(F.array(F.lit(0).cast("long"), "total")).alias("s"))).distinct()
    regions = edges.withColumn("e", F.lead("s").over(Window.partitionBy("rec_id").orderBy("s"))).where("e > s")
    inside = kept.select("rec_id", "s", F.lit(True).alias("kept"))
    return regions.join(inside, ["rec_id", "s"], "left").select("rec_id", "s", "e", F.coalesce("kept", F.lit(False)).alias("kept"), F.greatest(F.col("s") - lead, F.lit(0)).alias("feed"))


def spread(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """``n`` evenly spaced rows of each key: those at floor(i * size / n)."""
    own = Window.partitionBy(*keys)
    placed = rows.withColumn("__at", F.row_number().over(own.orderBy(*order)) - 1).withColumn("__size", F.count("*").over(own))
    hit = F.ceil(F.col("__at") * n / F.col("__size"))
    return placed.where((hit < n) & (F.floor(hit * F.col("__size") / n) == F.col("__at"))).drop("__at", "__size")


#: Fixed values of sample choice in ms: a window and its step, the margin around others, clean speech needed, how far below
#: the best coverage is kept; and how many windows stay.
WINDOW_MS, STEP_MS, MARGIN_MS, CLEAN_MS, BELOW_MS, MOST_WINDOWS = 3000, 250, 150, 1500, 500, 48
#: Fixed values in ms: the longest piece that speaks for a voice, the shortest end of a longer span, the shortest piece.
PIECE_MS, TAIL_MS, CRUMB_MS = 6000, 1000, 300


def _alone(turns: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """By voice, as rec_id a struct of recording and speaker: the whole time, own speech, time near others, and own speech away from it."""
    who = turns.select("rec_id", F.col("speaker").alias("me")).distinct()
    key = F.struct("rec_id", "me").alias("rec_id")
    whole = who.join(totals, "rec_id").select(key, F.lit(0).cast("long").alias("s"), F.col("total").cast("long").alias("e"))
    held = turns.join(totals, "rec_id").select("rec_id", "speaker", F.greatest("s", F.lit(0)).alias("s"), F.least("e", "total").alias("e"), "total")
    own = merge_spans(held.select(F.struct("rec_id", F.col("speaker").alias("me")).alias("rec_id"), "s", "e"))
    wide = held.join(who, "rec_id").where("me <> speaker").select(key, F.greatest(F.col("s") - MARGIN_MS, F.lit(0)).alias("s"), F.least(F.col("e") + MARGIN_MS, "total").alias("e"))
    return whole, own, wide, subtract_spans(own, wide)


def clean_speech(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """(rec_id, speaker, s, e) of turns (rec_id, speaker, s, e) where no other speaker is near."""
    return _alone(turns, totals)[3].select(F.col("rec_id.rec_id").alias("rec_id"), F.col("rec_id.me").alias("speaker"), "s", "e")


def sample_pieces(clean: DataFrame) -> DataFrame:
    """Clean speech (rec_id, speaker, s, e) in pieces of ``PIECE_MS`` at most, as (rec_id, speaker, piece, s, dur_ms) by time.

    What is left at a span's end counts only if it lasts ``TAIL_MS``, or if the whole span is shorter than that.
    """
    begins = clean.where("e > s").select("*", F.explode(F.sequence("s", F.col("e") - 1, F.lit(PIECE_MS).cast("long"))).alias("at"))
    dur = F.least(F.col("e"), F.col("at") + PIECE_MS) - F.col("at")
    kept = begins.where((dur >= TAIL_MS) | (F.col("e") - F.col("s") < TAIL_MS))
    number = F.row_number().over(Window.partitionBy("rec_id", "speaker").orderBy("at")) - 1
    return kept.select("rec_id", "speaker", number.alias("piece"), F.col("at").alias("s"), dur.alias("dur_ms"))


def candidate_windows(turns: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows (rec_id, speaker, start_ms, covered) from which a speaker may be sampled, and (rec_id, speaker, clean_ms, enough).

    Windows lie, step by step, where no other speaker of turns (rec_id, speaker, s, e) is near; those count in which the
    speaker talks half the time or more and nearly as much as in the best, thinned to ``MOST_WINDOWS``. A speaker with too little
    speech alone has none.
    """
    whole, own, wide, pieces = _alone(turns, totals)
    clean = pieces.groupBy("rec_id").agg(F.sum(F.col("e") - F.col("s")).alias("clean"))
    told = whole.select("rec_id").join(clean, "rec_id", "left").select("rec_id", F.coalesce("clean", F.lit(0)).alias("clean_ms"))
    told = told.withColumn("enough", F.col("clean_ms") >= CLEAN_MS)
    free = subtract_spans(whole, wide).where(F.col("e") - F.col("s") >= WINDOW_MS).join(told.where("enough").select("rec_id"), "rec_id", "left_semi")
    windows = free.select("rec_id", F.explode(F.sequence(F.col("s"), F.col("e") - WINDOW_MS, F.lit(STEP_MS).cast("long"))).alias("ws")).withColumn("we", F.col("ws") + WINDOW_MS)
    met = coverage(windows, own).where(F.col("covered") * 2 >= WINDOW_MS)
    near = met.withColumn("best", F.max("covered").over(Window.partitionBy("rec_id"))).where(F.col("covered") >= F.col("best") - BELOW_MS)
    kept = spread(near.drop("best"), ["rec_id"], ["ws"], MOST_WINDOWS)
    name = [F.col("rec_id.rec_id").alias("rec_id"), F.col("rec_id.me").alias("speaker")]
    return kept.select(*name, F.col("ws").alias("start_ms"), "covered"), told.select(*name, "clean_ms", "enough")


def choose_sample(windows: DataFrame, centroids: DataFrame) -> DataFrame:
    """The window (rec_id, speaker, start_ms, embedding) nearest to each speaker's centroid (rec_id, speaker, centroid), the first of equals."""
    from tidewords.functions.scalar import cosine

    met = windows.join(centroids, ["rec_id", "speaker"]).withColumn("similarity", cosine(F.col("embedding"), F.col("centroid")))
    best = F.max_by(F.struct("start_ms", "similarity"), F.struct("similarity", -F.col("start_ms"))).alias("b")
    return met.groupBy("rec_id", "speaker").agg(best).select("rec_id", "speaker", "b.start_ms", "b.similarity")


def assemble_sample(pieces: DataFrame, centroids: DataFrame) -> DataFrame:
    """(rec_id, speaker, ord, s, taken_ms): clean pieces (rec_id, speaker, s, e, embedding) joined to a sample of ``WINDOW_MS``.

    For voices without a window of their own. Pieces nearest to the centroid (rec_id, speaker, centroid) come first, the earlier of
    equals; all of them again until the sample is full, the last cut. Pieces under ``CRUMB_MS`` aren't used; a voice that has
    no others has no sample. Rows a voice: as many as crumbs fit into a sample at most.
    """
    from tidewords.functions.scalar import cosine

    voice = ["rec_id", "speaker"]
    near = pieces.where(F.col("e") - F.col("s") >= CRUMB_MS).join(centroids, voice).select(*voice, "s", (F.col("e") - F.col("s")).alias("dur"), cosine(F.col("embedding"), F.col("centroid")).alias("c"))
    order = Window.partitionBy(*voice).orderBy(F.desc("c"), "s")
    placed = near.withColumns({"__before": F.sum("dur").over(order.rowsBetween(Window.unboundedPreceding, -1)), "__all": F.sum("dur").over(Window.partitionBy(*voice))})
    first = placed.withColumn("__before", F.coalesce("__before", F.lit(0))).where(F.col("__before") < WINDOW_MS)
    rounds = F.sequence(F.lit(0).cast("long"), F.floor((WINDOW_MS - 1 - F.col("__before")) / F.col("__all")))
    laid = first.select("*", F.explode(rounds).alias("__round")).withColumn("__at", F.col("__round") * F.col("__all") + F.col("__before"))
    number = F.row_number().over(Window.partitionBy(*voice).orderBy("__at")) - 1
    return laid.select(*voice, number.alias("ord"), "s", F.least(F.col("dur"), WINDOW_MS - F.col("__at")).alias("taken_ms"))
