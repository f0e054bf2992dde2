"""Tracks of separated voices: leaks and echoes taken out, and the transcripts of all voices put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions.scalar import power_db, word_key
from tidewords.operators.patterns import meet, range_join
from tidewords.operators.spans import transcript_silences

#: The leak's floor and silence in dB, the shortest measured stretch in ms, an echo's window and the gap that
#: parts runs in ms, and the margin in dB that a single word needs.
FLOOR_DB, SILENT_DB, LEAST_MS, ECHO_MS, RUN_MS, MARGIN_DB = -25.0, -70.0, 80, 500, 1000, 3.0


def levels(words: DataFrame, samples: DataFrame, keys: list[str], sample_ms: int = 1) -> DataFrame:
    """``words`` (keys, wid, start_ms, end_ms) with db: the loudness of their stretch, of 80 ms at least; null without samples.

    Samples (rec_id, idx, v) last ``sample_ms`` each; they meet words by time cells.
    """
    w = words.select(*keys, "wid", F.greatest("start_ms", F.lit(0)).alias("__a"), F.greatest(F.col("end_ms"), F.col("start_ms") + LEAST_MS).alias("__b"))
    s = samples.select("rec_id", (F.col("idx") * sample_ms).alias("__s"), ((F.col("idx") + 1) * sample_ms).alias("__e"), "v")
    met = range_join(w, s, "rec_id", 1000, ("__a", "__b"), ("__s", "__e")).where("__s >= __a AND __e <= __b")
    loud = met.groupBy(*keys, "wid").agg(power_db(F.avg(F.col("v") * F.col("v"))).alias("db"))
    return words.join(loud, [*keys, "wid"], "left")


def leaks(words: DataFrame, floor_db: float = FLOOR_DB) -> DataFrame:
    """Words (…, own_db, rec_db) that aren't their track's: much quieter in it than in a recording that isn't silent there.

    Silence in the track (null) is a leak where the recording has sound. A floor of 0 or more turns this off.
    """
    return words.where(F.lit(floor_db < 0) & (F.col("rec_db") >= SILENT_DB) & (F.coalesce(F.col("own_db"), F.lit(float("-inf"))) - F.col("rec_db") < floor_db))


def echo_pairs(words: DataFrame) -> DataFrame:
    """(rec_id, a, b): words (rec_id, track, seq, word, start_ms, db) of two tracks with the same letters that start within half a second.

    Starts meet in cells of the window's width and their neighbours, so no word meets its whole recording.
    """
    w = words.withColumn("key", word_key(F.col("word"))).where("key <> ''").select("rec_id", "key", F.floor(F.col("start_ms") / ECHO_MS).alias("cell"), F.struct("track", "seq", "start_ms", "db").alias("w"))
    b = w.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).withColumnRenamed("w", "b")
    met = w.withColumnRenamed("w", "a").join(b, ["rec_id", "key", "cell"])
    return met.where((F.col("a.track") < F.col("b.track")) & (F.abs(F.col("a.start_ms") - F.col("b.start_ms")) < ECHO_MS)).select("rec_id", "a", "b")


def echoes(words: DataFrame) -> DataFrame:
    """(rec_id, track, seq) of words to drop: the quieter copies of what two tracks both say.

    Pairs of two tracks form runs in order of the first track's words while both go on by one word at most and a second at
    most. A run of several words, or a single one that differs by 3 dB, loses the copy that is quieter on the whole, the first
    track's if they are equal.
    """
    p = echo_pairs(words).select("rec_id", F.col("a.track").alias("ta"), F.col("b.track").alias("tb"), "a", "b")
    keys = ["rec_id", "ta", "tb"]
    order = Window.partitionBy(*keys).orderBy("a.seq", "b.seq")
    step = lambda side, field: F.col(f"{side}.{field}") - F.lag(F.col(f"{side}.{field}")).over(order)
    goes_on = (step("a", "seq") <= 1) & (step("b", "seq") <= 1) & (step("a", "start_ms") <= RUN_MS)
    marked = p.withColumn("opens", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "run")
    told = runs.withColumns({"n": F.count("*").over(own), "la": F.avg("a.db").over(own), "lb": F.avg("b.db").over(own)})
    quiet = told.where((F.col("n") > 1) | (F.abs(F.col("la") - F.col("lb")) >= MARGIN_DB)).select("rec_id", F.when(F.col("la") > F.col("lb"), F.col("b")).otherwise(F.col("a")).alias("w"))
    return quiet.select("rec_id", "w.track", "w.seq").distinct()


def prune(segments: DataFrame, words: DataFrame, drops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments (rec_id, id, start_ms, end_ms, text) without the dropped words (rec_id, id, seq), and how many went.

    Text and times are made anew only where something was dropped; a segment that loses all its words goes, one that
    never had any stays.
    """
    marked = meet(words, drops.select("rec_id", "id", "seq").distinct().withColumn("__gone", F.lit(True)), ["rec_id", "id", "seq"]).withColumn("__gone", F.coalesce("__gone", F.lit(False)))
    left = F.col("__gone") == False  # noqa: E712
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(left, F.struct("seq", "word")))), lambda x: x["word"]), " ")
    own = marked.groupBy("rec_id", "id").agg(F.count_if(F.col("__gone")).alias("gone"), F.count_if(left).alias("left"), text.alias("t"), F.min_by(F.when(left, F.col("start_ms")), F.when(left, F.col("seq"))).alias("a"), F.max_by(F.when(left, F.col("end_ms")), F.when(left, F.col("seq"))).alias("b"))
    met = meet(segments, own, ["rec_id", "id"])
    cut = F.coalesce(F.col("gone") > 0, F.lit(False))
    kept = met.where(F.coalesce(F.col("left") > 0, F.lit(True))).withColumns({"text": F.when(cut, F.col("t")).otherwise(F.col("text")), "start_ms": F.when(cut, F.col("a")).otherwise(F.col("start_ms")), "end_ms": F.when(cut, F.col("b")).otherwise(F.col("end_ms"))})
    gone = met.groupBy("rec_id").agg(F.coalesce(F.sum("gone"), F.lit(0)).alias("dropped"))
    return kept.select(*segments.columns), gone.withColumn("warning", F.when(F.col("dropped") > 0, "isolation_leaks_dropped"))


def missing_voices(voices: DataFrame, tracks: DataFrame) -> DataFrame:
    """(rec_id, code, message): the voices (rec_id, ord, speaker) of which there is no track, one warning a recording."""
    gone = voices.join(tracks.select("rec_id", "speaker").distinct(), ["rec_id", "speaker"], "left_anti")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "speaker"))), lambda x: x["speaker"]), ", ")
    return gone.groupBy("rec_id").agg(F.lit("isolation_voices_missing").alias("code"), F.concat(F.lit("not in the transcript, for want of a track: "), names).alias("message"))


def merge_tracks(voices: DataFrame, segments: DataFrame, durations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transcripts of a recording's voices as one: segments, speakers, and (rec_id, text, speech_ratio, rtf).

    ``segments`` has (rec_id, speaker, ord, start_ms, end_ms, text) of each track, ``voices`` their order and
    ``durations`` (rec_id, total, processing_ms). Blank segments go; the others are ordered by start and voice and
    numbered anew on channel 0.
    """
    order = voices.select("rec_id", "speaker", F.col("ord").alias("voice"))
    kept = segments.where(F.trim("text") != "").join(order, ["rec_id", "speaker"])
    numbered = kept.withColumn("id", F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms", "voice", "ord")) - 1).select("rec_id", "id", "speaker", F.lit(0).alias("channel"), "start_ms", "end_ms", F.trim("text").alias("text"), "voice")
    spoken = numbered.groupBy("rec_id", "voice", "speaker").agg(F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000, 2).alias("total_speech"), F.count("*").alias("segments"))
    tracks = segments.select("rec_id", "speaker").distinct().join(order, ["rec_id", "speaker"])
    speakers = tracks.join(spoken, ["rec_id", "voice", "speaker"], "left").select("rec_id", "voice", "speaker", F.coalesce("total_speech", F.lit(0.0)).alias("total_speech"), F.coalesce("segments", F.lit(0)).alias("segments"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ")
    ratio = transcript_silences(numbered, durations.select("rec_id", "total")).select("rec_id", "speech_ratio").distinct()
    whole = durations.join(numbered.groupBy("rec_id").agg(text.alias("text"), F.count("*").alias("segments")), "rec_id", "left").join(ratio, "rec_id", "left")
    rtf = F.when(F.col("total") > 0, F.col("processing_ms") / F.col("total")).otherwise(0.0)
    return numbered.drop("voice"), speakers, whole.select("rec_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("speech_ratio", F.lit(0.0)).alias("speech_ratio"), rtf.alias("rtf"))
