"""Who said what: attribution of words to turns, speaker runs, segment splitting and speaker figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions.scalar import speaker_name_clean
from tidewords.operators.patterns import asof_last, before, islands, range_join
from tidewords.sources.shared import settle

#: Confidence without overlap, the shortest turn, a word's vote in ms.
FALLBACK, TURN_MS, TURN_WORDS, VOTE_MS = 0.3, 500, 2, 10


def assign_speakers(words: DataFrame, turns: DataFrame, width: int = 5000) -> DataFrame:
    """(rec_id, wid, speaker, confidence): the turn that overlaps a word most, the first of equals.

    Words without any overlap are left out; ``attribute`` gives them the nearest turn.
    """
    w = words.select("rec_id", "wid", F.col("start_ms").alias("ws"), F.col("end_ms").alias("we"))
    t = turns.select("rec_id", "turn_ord", "speaker", F.col("start_ms").alias("ts"), F.col("end_ms").alias("te"))
    overlap = F.least("we", "te") - F.greatest("ws", "ts")
    best = F.max_by(F.struct("speaker", "overlap"), F.struct("overlap", -F.col("turn_ord"))).alias("best")
    found = range_join(w, t, "rec_id", width, ("ws", "we"), ("ts", "te")).withColumn("overlap", overlap)
    return found.groupBy("rec_id", "wid", "ws", "we").agg(best).select("rec_id", "wid", F.col("best.speaker").alias("speaker"), F.least(F.lit(1.0), F.col("best.overlap") / (F.col("we") - F.col("ws"))).alias("confidence"))


def nearest_turn(words: DataFrame, turns: DataFrame, width: int = 5000) -> DataFrame:
    """(rec_id, wid, speaker, confidence): the turn nearest to each word's middle, the first of equals.

    Distances are in half milliseconds. A turn that holds the middle is found by a range join, else the last end before
    it and the first start after it by as-of joins; so no word meets all turns of its recording.
    """
    w = words.select("rec_id", "wid", (F.col("start_ms") + F.col("end_ms")).alias("m"), (F.col("start_ms") + F.col("end_ms") + 1).alias("m1"))
    t = turns.select("rec_id", "turn_ord", "speaker", (2 * F.col("start_ms")).alias("ts"), (2 * F.col("end_ms")).alias("te"), (2 * F.col("end_ms") + 1).alias("te1"))
    inside = range_join(w, t, "rec_id", 2 * width, ("m", "m1"), ("ts", "te1")).select("rec_id", "wid", F.lit(0).cast("long").alias("far"), "turn_ord", "speaker")
    first = t.withColumn("tie", -F.col("turn_ord"))
    back = asof_last(first, w.select("rec_id", "wid", "m"), "rec_id", "te", "m", ["te", "turn_ord", "speaker"], "tie")
    ahead = asof_last(first.withColumn("at", -F.col("ts")), w.select("rec_id", "wid", (-F.col("m")).alias("m")), "rec_id", "at", "m", ["ts", "turn_ord", "speaker"], "tie")
    found = inside.unionByName(back.where("turn_ord IS NOT NULL").select("rec_id", "wid", (F.col("m") - F.col("te")).alias("far"), "turn_ord", "speaker"))
    found = found.unionByName(ahead.where("turn_ord IS NOT NULL").select("rec_id", "wid", (F.col("ts") + F.col("m")).alias("far"), "turn_ord", "speaker"))
    return found.groupBy("rec_id", "wid").agg(F.min_by("speaker", F.struct("far", "turn_ord")).alias("speaker")).withColumn("confidence", F.lit(FALLBACK))


def attribute(words: DataFrame, turns: DataFrame) -> DataFrame:
    """``words`` with speaker and speaker_conf; null where the recording has no turns. Words and turns are read several times."""
    sure = assign_speakers(words, turns).withColumn("sure", F.lit(True))
    met = settle(words.join(sure, ["rec_id", "wid"], "left"))
    rest = nearest_turn(met.where("sure IS NULL"), turns).select("rec_id", "wid", F.col("speaker").alias("near"), F.col("confidence").alias("near_conf"))
    return met.join(rest, ["rec_id", "wid"], "left").withColumns({"speaker": F.coalesce("speaker", "near"), "speaker_conf": F.coalesce("confidence", "near_conf")}).drop("confidence", "near", "near_conf", "sure")


def guard_attribution(words: DataFrame, attributed: DataFrame) -> DataFrame:
    """(rec_id, n_words, n_attributed, warning): recordings whose attributions don't fit their words stay unattributed."""
    n = words.groupBy("rec_id").agg(F.count("*").alias("n_words"))
    m = attributed.groupBy("rec_id").agg(F.count("*").alias("n_attributed"))
    odd = F.col("n_words") != F.coalesce("n_attributed", F.lit(0))
    return n.join(m, "rec_id", "left").select("rec_id", "n_words", F.coalesce("n_attributed", F.lit(0)).alias("n_attributed"), F.when(odd, "diarization_unavailable").alias("warning"))


def speaker_runs(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``words`` with ``group``: the number of the speaker's turn inside its segment (``keys``).

    Runs of one speaker (null equals null) of at least two words and half a second are turns; other runs join
    the group before them, and so does a turn of the group's speaker. The first run opens a group whatever its
    length; if it is no turn itself, its group is joined to the next.
    """
    at = Window.partitionBy(*keys).orderBy(order)
    begins = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(at)) | (F.row_number().over(at) == 1)
    w = islands(words.withColumn("__begins", begins), keys, [order], F.col("__begins"), "__run")
    run = Window.partitionBy(*keys, "__run")
    whole = run.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns({"__n": F.count("*").over(run), "__a": F.first("start_ms").over(whole), "__b": F.last("end_ms").over(whole)})
    turn = (F.col("__n") >= TURN_WORDS) & (F.col("__b") - F.col("__a") >= TURN_MS)
    first = F.col("__run") == 1
    # told at a run's first word alone: is it kept, and who was the last one kept before it?
    w = w.withColumn("__kept", F.col("__begins") & (first | turn))
    held = F.last(F.when(F.col("__kept"), F.struct(F.col("speaker").alias("who"))), ignorenulls=True).over(before(keys, [order]))
    w = w.withColumn("__held", held)
    w = islands(w, keys, [order], F.col("__kept") & (first | ~F.col("speaker").eqNullSafe(F.col("__held.who"))), "group")
    own = Window.partitionBy(*keys)
    head = lambda c: F.when(F.col("group") == 1, c)
    long = (F.count(head(F.lit(1))).over(own) >= TURN_WORDS) & (F.max(head(F.col("__b"))).over(own) - F.min(head(F.col("__a"))).over(own) >= TURN_MS)
    short = (F.max("group").over(own) > 1) & ~long
    return w.withColumn("group", F.when(short, F.greatest(F.col("group") - 1, F.lit(1))).otherwise(F.col("group")) - 1).drop("__begins", "__run", "__n", "__a", "__b", "__kept", "__held")


def dominant_speaker(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, speaker): who speaks longest, each word counting 10 ms more; the smaller name of equals, null if none."""
    time = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) + VOTE_MS
    sums = words.groupBy(*keys, "speaker").agg(F.sum(F.when(F.col("speaker").isNotNull(), time)).alias("t"))
    return sums.groupBy(*keys).agg(F.min_by("speaker", F.when(F.col("speaker").isNotNull(), F.struct(-F.col("t"), F.col("speaker").cast("string")))).alias("speaker"))


def split_segments(segments: DataFrame, words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Segments cut at their speakers' turns: keys, part, speaker, start_ms, end_ms, n_words, text.

    The first part keeps its segment's start and the last its end; segments without words stay whole.
    """
    w = speaker_runs(words, keys, order)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "word"))), lambda x: x["word"]), " ")
    vote = F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) + VOTE_MS).over(Window.partitionBy(*keys, "group", "speaker"))
    who = F.min_by("speaker", F.when(F.col("speaker").isNotNull(), F.struct(-F.col("__vote"), F.col("speaker").cast("string"))))  # as in dominant_speaker
    parts = w.withColumn("__vote", vote).groupBy(*keys, "group").agg(F.min_by("start_ms", order).alias("a"), F.max_by("end_ms", order).alias("b"), F.count("*").alias("n"), text.alias("t"), who.alias("speaker"))
    own = Window.partitionBy(*keys)
    parts = parts.withColumn("last", F.max("group").over(own))
    s = segments.select(*keys, F.col("start_ms").alias("ss"), F.col("end_ms").alias("se"), F.col("text").alias("st"))
    joined = s.join(parts, keys, "left")
    return joined.select(
        *keys, F.coalesce("group", F.lit(0)).alias("part"), "speaker",
        F.when(F.coalesce("group", F.lit(0)) == 0, F.col("ss")).otherwise(F.col("a")).alias("start_ms"),
        F.when(F.coalesce(F.col("group") == F.col("last"), F.lit(True)), F.col("se")).otherwise(F.col("b")).alias("end_ms"),
        F.coalesce("n", F.lit(0)).alias("n_words"), F.coalesce("t", "st").alias("text"),
    )


def speaker_summary(segments: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Speech and segments of each speaker; segments without one are left out."""
    return segments.where(F.col("speaker").isNotNull()).groupBy(*keys, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"), F.count("*").alias("segments"))


def average_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the known confidences (thousandths above 0), 0 where none is known."""
    return words.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("conf_milli") > 0, F.col("conf_milli"))), F.lit(0.0)).alias("avg_conf"))


def renumber_by_first_appearance(turns: DataFrame) -> DataFrame:
    """Speakers numbered from 0 by their earliest start, then by old number."""
    first = turns.groupBy("rec_id", "speaker").agg(F.min("start_ms").alias("f"))
    number = F.row_number().over(Window.partitionBy("rec_id").orderBy("f", "speaker")) - 1
    return turns.join(first.select("rec_id", "speaker", number.alias("number")), ["rec_id", "speaker"]).drop("speaker").withColumnRenamed("number", "speaker")


def voice_table(turns: DataFrame) -> DataFrame:
    """Turns and seconds (two decimals) of each voice, longest first; ids by first appearance, empty turns ignored."""
    own = renumber_by_first_appearance(turns.where("end_ms > start_ms"))
    sums = own.groupBy("rec_id", "speaker").agg(F.count("*").alias("turns"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    rank = F.row_number().over(Window.partitionBy("rec_id").orderBy(F.desc("ms"), "speaker"))
    return sums.select("rec_id", "speaker", "turns", F.round(F.col("ms") / 1000, 2).alias("seconds"), rank.alias("rank"))


def drop_tiny_speakers(turns: DataFrame, share: float) -> DataFrame:
    """Turns of the speakers who hold at least ``share`` of all turn time."""
    length = F.col("end_ms") - F.col("start_ms")
    mine = F.sum(length).over(Window.partitionBy("rec_id", "speaker"))
    return turns.withColumn("__mine", mine).withColumn("__all", F.sum(length).over(Window.partitionBy("rec_id"))).where(F.col("__mine") >= share * F.col("__all")).drop("__mine", "__all")


def _reach_of_others(segments: DataFrame) -> DataFrame:
    """(rec_id, ord, reach): the latest end before a segment among the other speakers.

    Only the speakers with the two latest ends matter: the latest of all, or of those who aren't that speaker.
    """
    earlier = before(["rec_id"], ["ord"])
    top = F.max(F.struct("end_ms", "speaker")).over(earlier)
    s = segments.withColumn("__top", top)
    own = segments.select("rec_id", "speaker").distinct().withColumnRenamed("speaker", "me")
    rest = segments.join(own, "rec_id").where("me <> speaker").groupBy("rec_id", "me", "ord").agg(F.max("end_ms").alias("end_ms"))
    asked = s.where(F.col("__top.speaker") == F.col("speaker")).select("rec_id", F.col("speaker").alias("me"), "ord", F.lit(None).cast("long").alias("end_ms"), F.lit(True).alias("asked"))
    both = rest.withColumn("asked", F.lit(False)).unionByName(asked)
    second = both.withColumn("reach", F.max("end_ms").over(before(["rec_id", "me"], ["ord", "asked"]))).where("asked").select("rec_id", "ord", "reach")
    return second.unionByName(s.where(F.col("__top.speaker") != F.col("speaker")).select("rec_id", "ord", F.col("__top.end_ms").alias("reach")))


def conversation_turns(segments: DataFrame, gap: int = 3000, overlap: int = 200) -> DataFrame:
    """Segments (rec_id, ord, speaker, start_ms, end_ms) as turns, with those that start while another speaks.

    A turn ends where the speaker changes or the next segment starts ``gap`` after the turn's latest end.
    """
    at = Window.partitionBy("rec_id").orderBy("ord")
    changed = (F.row_number().over(at) == 1) | ~F.col("speaker").eqNullSafe(F.lag("speaker").over(at))
    s = islands(segments, ["rec_id"], ["ord"], changed, "run")
    reach = F.max("end_ms").over(before(["rec_id", "run"], ["ord"]))
    s = islands(s.withColumn("changed", F.row_number().over(Window.partitionBy("rec_id", "run").orderBy("ord")) == 1).withColumn("late", F.col("start_ms") - reach >= gap), ["rec_id"], ["ord"], F.col("changed") | F.coalesce(F.col("late"), F.lit(False)), "turn")
    others = _reach_of_others(s)
    s = s.join(others, ["rec_id", "ord"], "left").withColumn("busy", F.col("reach") > F.col("start_ms") + overlap)
    return s.groupBy("rec_id", "turn").agg(F.min_by("speaker", "ord").alias("speaker"), F.min_by("start_ms", "ord").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("segments"), F.coalesce(F.min_by("busy", "ord"), F.lit(False)).alias("overlaps"))


def speaker_shares(segments: DataFrame, turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """(rec_id, speaker, seconds_ms, words, turns, share) of each listed speaker, also of those without segments.

    ``speakers`` has (rec_id, speaker, total_ms). Words are a segment's words, or the fields of its text where it has none.
    """
    said = F.when(F.col("n_words") > 0, F.col("n_words")).otherwise(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    words = segments.groupBy("rec_id", "speaker").agg(F.sum(said).alias("words"))
    taken = turns.groupBy("rec_id", "speaker").agg(F.count("*").alias("turns"))
    total = F.sum("total_ms").over(Window.partitionBy("rec_id"))
    met = speakers.join(words, ["rec_id", "speaker"], "left").join(taken, ["rec_id", "speaker"], "left")
    return met.select("rec_id", "speaker", F.col("total_ms").alias("spoken_ms"), F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.coalesce("turns", F.lit(0)).alias("turns"), F.when(total > 0, F.col("total_ms") / total).otherwise(0.0).alias("share"))


def name_speakers(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Segments with the names people gave the speakers; a blank or missing name leaves the id."""
    given = names.select("rec_id", "speaker", F.nullif(F.trim("name"), F.lit("")).alias("__name"))
    return segments.join(given, ["rec_id", "speaker"], "left").withColumn("speaker", F.coalesce("__name", "speaker")).drop("__name")


def rename_speakers(jobs: DataFrame, speakers: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names (rec_id, speaker, name) that may be given, cleaned, and those refused with a reason.

    The job must have succeeded, the speaker be one of its own, and the name at most 64 characters.
    """
    own = speakers.select("rec_id", "speaker").distinct().withColumn("__known", F.lit(True))
    marked = renames.join(jobs.select("rec_id", "status"), "rec_id", "left").join(own, ["rec_id", "speaker"], "left").withColumn("__clean", speaker_name_clean(F.col("name")))
    reason = F.when(F.col("status").isNull(), "no such job").when(F.col("status") != "succeeded", "not finished").when(F.col("__known").isNull(), "no such speaker").when(F.col("__clean").isNull(), "long name")
    marked = marked.withColumn("reason", reason)
    return marked.where("reason IS NULL").select("rec_id", "speaker", F.col("__clean").alias("name")), marked.where("reason IS NOT NULL").select("rec_id", "speaker", "name", "reason")


def frames_to_turns(logits: DataFrame, durations: DataFrame, frame_ms: int = 10) -> DataFrame:
    """(rec_id, turn_ord, speaker, start_ms, end_ms) of frames (rec_id, speaker, frame, logit): runs above 0.

    Frames past the recording's valid ones (durations: rec_id, valid, duration_ms) are padding; ends stop at the
    duration; speakers are numbered by first appearance.
    """
    on = logits.join(durations, "rec_id").where((F.col("frame") < F.col("valid")) & (F.col("logit") > 0))
    island = F.col("frame") - F.row_number().over(Window.partitionBy("rec_id", "speaker").orderBy("frame"))
    runs = on.withColumn("run", island).groupBy("rec_id", "speaker", "run", "duration_ms").agg(F.min("frame").alias("a"), (F.max("frame") + 1).alias("b"))
    turns = runs.select("rec_id", "speaker", (F.col("a") * frame_ms).alias("start_ms"), F.least(F.col("b") * frame_ms, "duration_ms").alias("end_ms"))
    placed = turns.withColumn("turn_ord", F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms", "speaker")) - 1)
    return renumber_by_first_appearance(placed)
