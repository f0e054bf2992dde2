"""How far a transcript or a diarization is from a reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions.alignment import best_mapping, edits

#: A scoring frame and the collar around reference edges in ms, words looked ahead in an alignment.
FRAME_MS, COLLAR_MS, LOOKAHEAD = 10, 250, 3


def read_rttm(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (rec, start_ms, end_ms, speaker) of lines (line) that begin with SPEAKER, and the lines whose times are no numbers.

    Lines of other kinds or with fewer than eight fields are passed over.
    """
    f = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.select("line", f.alias("f")).where((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER"))
    timed = rows.select("line", F.col("f")[1].alias("rec"), F.expr("try_cast(f[3] as double)").alias("start"), F.expr("try_cast(f[4] as double)").alias("dur"), F.col("f")[7].alias("speaker"))
    ms = lambda c: F.round(c * 1000).cast("long")
    good = timed.where("start IS NOT NULL AND dur IS NOT NULL")
    return good.select("rec", ms(F.col("start")).alias("start_ms"), ms(F.col("start") + F.col("dur")).alias("end_ms"), "speaker"), timed.where("start IS NULL OR dur IS NULL").select("line")


def _pieces(reference: DataFrame, hypothesis: DataFrame, collar_ms: int) -> DataFrame:
    """(rec_id, n, ref, hyp): stretches of frames between edges, outside the collar, with the speakers that hold them.

    Edges of turns and collars are numbered within a recording, so that a turn holds the pieces between two numbers; of turns
    that overlap the last listed holds a piece. Rows grow with turns and with how many pieces each of them covers, not with time.
    """
    frame = lambda c: F.floor(F.greatest(c, F.lit(0)) / FRAME_MS)
    side = lambda t, k: t.select("rec_id", F.lit(k).alias("side"), "turn_ord", F.col("speaker").cast("string").alias("speaker"), frame(F.col("start_ms")).alias("a"), frame(F.col("end_ms")).alias("b"))
    collar = reference.select("rec_id", F.explode(F.array("start_ms", "end_ms")).alias("x"))
    collar = collar.select("rec_id", F.lit(2).alias("side"), F.lit(0).alias("turn_ord"), F.lit(None).cast("string").alias("speaker"), frame(F.col("x") - collar_ms).alias("a"), frame(F.col("x") + collar_ms).alias("b"))
    spans = side(reference, 0).unionByName(side(hypothesis, 1)).unionByName(collar).where("b > a").withColumn("held", F.struct("side", "turn_ord", "speaker", "a", "b"))
    by_edge = Window.partitionBy("rec_id").orderBy("x")
    edges = spans.select("rec_id", "held", F.explode(F.array("a", "b")).alias("x")).withColumns({"e": F.dense_rank().over(by_edge), "next": F.lead("x").over(by_edge)})
    covers = edges.groupBy("rec_id", "held").agg(F.min("e").alias("i"), F.max("e").alias("j"))
    lengths = edges.groupBy("rec_id", "e").agg(F.max(F.col("next") - F.col("x")).alias("n")).where("n > 0")
    laid = covers.select("rec_id", "held.side", "held.turn_ord", "held.speaker", F.explode(F.sequence("i", F.col("j") - 1)).alias("e"), F.lit(None).cast("long").alias("n"))
    laid = laid.unionByName(lengths.select("rec_id", F.lit(3).alias("side"), F.lit(0).alias("turn_ord"), F.lit(None).cast("string").alias("speaker"), "e", "n"))
    last = lambda k: F.max(F.when(F.col("side") == k, F.struct("turn_ord", "speaker")))["speaker"]
    pieces = laid.groupBy("rec_id", "e").agg(F.max("n").alias("n"), last(0).alias("ref"), last(1).alias("hyp"), F.max((F.col("side") == 2).cast("int")).alias("near"))
    return pieces.where("near = 0").select("rec_id", "n", "ref", "hyp")


def _right(refs: pd.Series, hyps: pd.Series, counts: pd.Series) -> pd.Series:
    """The most frames that a one-to-one mapping of speakers explains, of each recording's table of speaker pairs."""
    out = []
    for r, h, n in zip(refs, hyps, counts, strict=True):
        (_, i), (_, j) = (np.unique(np.array(list(x), object), return_inverse=True) for x in (r, h))
        table = np.zeros((i.max() + 1, j.max() + 1), np.int64) if len(i) else np.zeros((0, 0), np.int64)
        np.add.at(table, (i, j), np.array(list(n), np.int64))
        out.append(best_mapping(table) if table.size else 0)
    return pd.Series(out)


def diarization_error(reference: DataFrame, hypothesis: DataFrame, collar_ms: int = COLLAR_MS) -> DataFrame:
    """(rec_id, speech, miss, false_alarm, confusion, error): frames of 10 ms, and the error's share of speech.

    Frames within the collar of a reference edge aren't scored. Speakers are mapped one to one so that the most
    frames agree, by assignment on each recording's table of speaker pairs. Turns (rec_id, turn_ord, speaker,
    start_ms, end_ms) without a frame count for nothing; a recording without any other has no row.
    """
    pairs = _pieces(reference, hypothesis, collar_ms).where("ref IS NOT NULL OR hyp IS NOT NULL").groupBy("rec_id", "ref", "hyp").agg(F.sum("n").alias("n"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    r, h = F.col("ref").isNotNull(), F.col("hyp").isNotNull()
    met = F.collect_list(F.when(r & h, F.struct("ref", "hyp", "n"))).alias("met")
    sums = pairs.groupBy("rec_id").agg(count(r).alias("speech"), count(r & ~h).alias("miss"), count(~r & h).alias("false_alarm"), count(r & h).alias("both"), met)
    sums = sums.withColumn("confusion", F.col("both") - F.pandas_udf(_right, "long")("met.ref", "met.hyp", "met.n"))
    wrong = F.col("miss") + F.col("false_alarm") + F.col("confusion")
    return sums.select("rec_id", "speech", "miss", "false_alarm", "confusion", F.when(F.col("speech") > 0, wrong / F.col("speech")).otherwise(F.lit(0.0)).alias("error"))


def spoken_words(text: Column) -> Column:
    """Words in lower case without punctuation and symbols at their ends; those of nothing else go."""
    bare = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def _edits(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edits(list(r), list(h)) for r, h in zip(refs, hyps, strict=True)], columns=["substituted", "inserted", "deleted"])


def word_error_rate(pairs: DataFrame) -> DataFrame:
    """``pairs`` (reference, hypothesis, …) with edits, substituted, inserted, deleted, words and wer: word edits over the reference's words.

    The distance is worked out a column of the table at a time, a bit a reference word, and the alignment by halving, so that
    memory grows with the words of a pair. Where alignments tie, one of them is counted. Without reference words the rate is 0 if there
    is nothing, else 1. Null texts have no words.
    """
    listed = pairs.withColumns({"__r": spoken_words(F.coalesce("reference", F.lit(""))), "__h": spoken_words(F.coalesce("hypothesis", F.lit("")))}).withColumn("__e", F.pandas_udf(_edits, "struct<substituted: int, inserted: int, deleted: int>")("__r", "__h"))
    parts = ("substituted", "inserted", "deleted")
    told = listed.withColumns({p: F.col(f"__e.{p}") for p in parts} | {"words": F.size("__r")}).withColumn("edits", sum((F.col(p) for p in parts), F.lit(0)))
    return told.withColumn("wer", F.when(F.col("words") > 0, F.col("edits") / F.col("words")).otherwise(F.when(F.size("__h") > 0, 1.0).otherwise(0.0))).drop("__r", "__h", "__e")


def _align(base: list[tuple[str, int]], other: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Places of words that agree, met in order with a short look ahead."""
    found, i, j = [], 0, 0
    ahead = lambda words, k, word: any(w == word for w, _ in words[k : k + LOOKAHEAD])
    while i < len(base) and j < len(other):
        if base[i][0] == other[j][0]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif ahead(other, j + 1, base[i][0]):
            j += 1
        elif ahead(base, i + 1, other[j][0]):
            i += 1
        else:
            i, j = i + 1, j + 1
    return found


def start_drift(base: DataFrame, other: DataFrame) -> DataFrame:
    """(rec_id, matched, median, mean, p95, most): how far the starts of the same words are apart, in ms.

    Words (rec_id, seq, word, start_ms) of a recording are aligned greedily, in one task a recording; percentiles
    are the sorted value at floor((n - 1) * q).
    """
    key = F.regexp_replace(F.lower("word"), r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "").alias("w")
    slim = lambda df: df.select("rec_id", "seq", key, "start_ms").toDF("rec_id", "seq", "w", "start_ms")

    def align(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b, o = (list(zip(x.sort_values("seq")["w"], x.sort_values("seq")["start_ms"], strict=True)) for x in (left, right))
        far = sorted(int(abs(o[j][1] - b[i][1])) for i, j in _align(b, o))
        at = lambda q: far[int((len(far) - 1) * q)]
        told = [(left["rec_id"].iloc[0], len(far), at(0.5), sum(far) / len(far), at(0.95), far[-1])] if far else []
        return pd.DataFrame(told, columns=["rec_id", "matched", "median", "mean", "p95", "most"])

    return slim(base).groupBy("rec_id").cogroup(slim(other).groupBy("rec_id")).applyInPandas(align, "rec_id long, matched long, median long, mean double, p95 long, most long")
