"""Transcripts as text: subtitles, tables, JSON and dialogue.

Exporters give a row a line or cue (rec_id, n, line), so that a long recording needs no large row; ``documents`` puts
a recording's lines together where a file is wanted. Segments have rec_id, id, speaker (null if unknown), start_ms,
end_ms and text, in order of id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions.scalar import clock_ms, logprob
from tidewords.operators.patterns import before, islands, meet

#: A line's characters, a cue's lines, the pause in ms that opens a cue.
WIDTH, LINES, PAUSE_MS = 1000, 2, 3000


def documents(lines: DataFrame, end: str = "\n") -> DataFrame:
    """(rec_id, body): a recording's lines in order, each closed by ``end``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(x["line"], F.lit(end)))
    return lines.groupBy("rec_id").agg(F.array_join(ordered, "").alias("body"))


def headed(lines: DataFrame, recordings: DataFrame, head: str) -> DataFrame:
    """Lines with one more before each recording's first, also for recordings without any."""
    return recordings.select("rec_id").distinct().select("rec_id", F.lit(0).cast("long").alias("n"), F.lit(head).alias("line")).unionByName(lines.select("rec_id", F.col("n").cast("long").alias("n"), "line"))


def bracketed(text: Column, speaker: Column) -> Column:
    return F.when(speaker.isNull(), text).otherwise(F.concat(F.lit("["), speaker, F.lit("]: "), text))


def text_lines(segments: DataFrame) -> DataFrame:
    """A trimmed line a segment, with its speaker in brackets."""
    return segments.select("rec_id", F.col("id").alias("n"), bracketed(F.trim("text"), F.col("speaker")).alias("line"))


def _cue(start: Column, end: Column, text: Column, mark: str, hours: bool = True) -> Column:
    code = lambda ms: clock_ms(ms, mark, True) if hours else F.when(ms >= 3_600_000, clock_ms(ms, mark, True)).otherwise(clock_ms(ms, mark, False))
    return F.concat(code(start), F.lit(" --> "), code(end), F.lit("\n"), text, F.lit("\n"))


def _named(segments: DataFrame) -> Column:
    """Has the transcript any speaker?"""
    return F.max(F.col("speaker").isNotNull()).over(Window.partitionBy("rec_id"))


def srt(segments: DataFrame) -> DataFrame:
    """A numbered cue a segment; the speaker before the text where the transcript has speakers."""
    s = segments.withColumn("named", _named(segments))
    text = F.when(F.col("named") & F.col("speaker").isNotNull(), F.concat("speaker", F.lit(": "), "text")).otherwise(F.col("text"))
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("id"))
    return s.select("rec_id", n.alias("n"), F.concat(n.cast("string"), F.lit("\n"), _cue(F.col("start_ms"), F.col("end_ms"), text, ",")).alias("line"))


def vtt(segments: DataFrame) -> DataFrame:
    """A cue a segment with the voice as a tag, under the format's heading."""
    s = segments.withColumn("named", _named(segments))
    text = F.when(F.col("named") & F.col("speaker").isNotNull(), F.concat(F.lit("<v "), "speaker", F.lit(">"), "text", F.lit("</v>"))).otherwise(F.col("text"))
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("id"))
    return headed(s.select("rec_id", n.alias("n"), _cue(F.col("start_ms"), F.col("end_ms"), text, ".").alias("line")), segments, "WEBVTT\n")


def tsv(segments: DataFrame) -> DataFrame:
    """Start and end in ms and the text of each segment, tabs in it as blanks, under a heading."""
    line = F.concat_ws("\t", F.greatest("start_ms", F.lit(0)).cast("string"), F.greatest("end_ms", F.lit(0)).cast("string"), F.replace(F.trim("text"), F.lit("\t"), F.lit(" ")))
    return headed(segments.select("rec_id", (F.col("id") + 1).alias("n"), line.alias("line")), segments, "start\tend\ttext")


def plain_text(segments: DataFrame) -> DataFrame:
    """(rec_id, text, json): all texts that aren't blank, joined by blanks; and the same as a JSON object."""
    said = F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("id", F.trim("text").alias("t"))))), lambda x: x["t"])
    return segments.groupBy("rec_id").agg(F.array_join(said, " ").alias("text")).withColumn("json", F.to_json(F.struct("text")))


def dialogue(segments: DataFrame) -> DataFrame:
    """A paragraph a turn: segments of one speaker in a row joined by blanks, the speaker before them."""
    s = segments.where(F.trim("text") != "").withColumn("who", F.coalesce("speaker", F.lit("")))
    at = Window.partitionBy("rec_id").orderBy("id")
    s = islands(s, ["rec_id"], ["id"], F.coalesce(F.lag("who").over(at) != F.col("who"), F.lit(True)), "n")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return s.groupBy("rec_id", "n", "who").agg(text.alias("t")).select("rec_id", "n", F.when(F.col("who") == "", F.col("t")).otherwise(F.concat("who", F.lit(": "), "t")).alias("line"))


def cue_lines(words: DataFrame) -> DataFrame:
    """Words (rec_id, seq, word, start_ms) with cue and row: how subtitles of ``WIDTH`` characters and ``LINES`` lines break.

    A pause between starts opens a cue; a word without room opens a line, and a cue when its lines are full. A
    stretch between pauses is filled by one fold over its words' lengths, which keeps only where lines begin.
    """
    at = Window.partitionBy("rec_id").orderBy("seq")
    w = islands(words, ["rec_id"], ["seq"], F.col("start_ms") - F.lag("start_ms").over(at) > PAUSE_MS, "part").withColumn("len", F.length("word"))
    w = w.withColumn("k", F.row_number().over(Window.partitionBy("rec_id", "part").orderBy("seq")) - 1)

    def fill(acc, x):
        opens = (acc["room"] == 0) | (acc["room"] + x["len"] > WIDTH)
        return F.when(opens, F.struct(F.length(F.trim(x["word"])).alias("room"), F.concat(acc["begins"], F.array(x["k"])).alias("begins"))).otherwise(F.struct((acc["room"] + x["len"]).alias("room"), acc["begins"].alias("begins")))

    cols = [c for c in words.columns if c != "rec_id"]
    filled = w.groupBy("rec_id", "part").agg(F.array_sort(F.collect_list(F.struct("k", "len", "word", F.struct(*cols).alias("r")))).alias("ws"))
    begins = F.aggregate("ws", F.struct(F.lit(0).alias("room"), F.array().cast("array<int>").alias("begins")), fill, lambda acc: acc["begins"])
    told = filled.select("rec_id", "ws", begins.alias("begins")).select("rec_id", "begins", F.inline("ws"))
    row, opens = F.size(F.filter("begins", lambda x: x <= F.col("k"))) - 1, F.array_contains("begins", F.col("k"))
    marked = told.select("rec_id", *(F.col("r")[c].alias(c) for c in cols), (row % LINES).alias("row"), opens.alias("opens"))
    return islands(marked, ["rec_id"], ["seq"], F.col("opens") & (F.col("row") == 0), "cue")


def cues(words: DataFrame, language: str = "") -> DataFrame:
    """(rec_id, cue, start_ms, end_ms, text): subtitles over all words of a recording, whatever its segments."""
    shown = F.when(F.col("opens"), F.concat(F.when(F.col("row") > 0, "\n").otherwise(""), F.trim("word"))).otherwise(F.col("word"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", shown.alias("w")))), lambda x: x["w"])
    made = cue_lines(words).groupBy("rec_id", "cue").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), cue_join(parts, language).alias("t"), F.min_by(F.struct("speaker"), "seq").alias("who"))
    return made.select("rec_id", "cue", "start_ms", "end_ms", bracketed(F.col("t"), F.col("who.speaker")).alias("text"))


def cue_join(words: Column, language: str) -> Column:
    """Words joined as their language does: without blanks in Japanese and Chinese."""
    return F.array_join(words, "" if language.split("-")[0] in ("ja", "zh") else " ")


def segment_cues(segments: DataFrame) -> DataFrame:
    """The cues of recordings whose words have no times: a segment each, arrows in it made harmless."""
    text = bracketed(F.replace(F.trim("text"), F.lit("-->"), F.lit("->")), F.col("speaker"))
    return segments.select("rec_id", (F.col("id") + 1).alias("cue"), "start_ms", "end_ms", text.alias("text"))


def all_cues(words: DataFrame, segments: DataFrame, language: str = "") -> DataFrame:
    """Cues from words, but from segments where a recording's first segment has no words."""
    first = segments.groupBy("rec_id").agg(F.min("id").alias("id"))
    timed = first.join(words.select("rec_id", "id").distinct(), ["rec_id", "id"], "left_semi").select("rec_id")
    return cues(words.join(timed, "rec_id", "left_semi"), language).unionByName(segment_cues(segments.join(timed, "rec_id", "left_anti")))


def cue_srt(found: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("cue"))
    return found.select("rec_id", n.alias("n"), F.concat(n.cast("string"), F.lit("\n"), _cue(F.col("start_ms"), F.col("end_ms"), F.col("text"), ",")).alias("line"))


def cue_vtt(found: DataFrame) -> DataFrame:
    """Hours are left out below one."""
    n = F.row_number().over(Window.partitionBy("rec_id").orderBy("cue"))
    return headed(found.select("rec_id", n.alias("n"), _cue(F.col("start_ms"), F.col("end_ms"), F.col("text"), ".", hours=False).alias("line")), found, "WEBVTT\n")


def word_json(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(rec_id, id, segment): each segment with its words as JSON, seconds with three decimals and a point."""
    seconds = lambda c: F.round(F.col(c) / 1000, 3)
    w = F.struct("word", seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), seconds("conf_milli").alias("score"), "speaker")
    own = words.groupBy("rec_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", w.alias("w")))), lambda x: x["w"]).alias("words"))
    joined = meet(segments, own, ["rec_id", "id"])
    line = F.struct(seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), F.trim("text").alias("text"), F.coalesce("words", F.array().cast(own.schema["words"].dataType)).alias("words"), "speaker")
    return joined.select("rec_id", "id", F.to_json(line).alias("segment"))


def verbose_segments(segments: DataFrame) -> DataFrame:
    """(rec_id, id, seek, start_ms, end_ms, text, speaker, avg_logprob): seek in hundredths of a second, cut off."""
    return segments.select("rec_id", "id", F.floor(F.col("start_ms") / 10).alias("seek"), "start_ms", "end_ms", "text", "speaker", logprob(F.col("avg_conf")).alias("avg_logprob"))


def verbose_words(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Words whose speaker is their own or else their segment's."""
    own = words.groupBy("rec_id", "id").agg(F.collect_list(F.struct(*(c for c in words.columns if c not in ("rec_id", "id")))).alias("__ws"))
    met = meet(segments.select("rec_id", "id", F.col("speaker").alias("__of")), own, ["rec_id", "id"]).select("rec_id", "id", "__of", F.inline("__ws"))
    return met.withColumn("speaker", F.coalesce("speaker", "__of")).select(*words.columns)


def word_document(segments: DataFrame, words: DataFrame, languages: DataFrame) -> DataFrame:
    """(rec_id, document): a recording's segments with their words, all words once more in one list, and its language (rec_id, language), as JSON.

    Recordings of ``languages`` without segments have empty lists.
    """
    seconds = lambda c: F.round(F.col(c) / 1000, 3)
    w = F.struct("word", seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), seconds("conf_milli").alias("score"), "speaker")
    own = words.groupBy("rec_id", "id").agg(_listed("words", "seq", w))
    line = F.struct(seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), F.trim("text").alias("text"), F.coalesce("words", F.array().cast(own.schema["words"].dataType)).alias("words"), "speaker")
    whole = meet(segments, own, ["rec_id", "id"]).groupBy("rec_id").agg(_listed("segments", "id", line))
    flat = F.flatten(F.transform("segments", lambda x: x["words"]))
    none = lambda c, like: F.coalesce(c, F.array().cast(like)).alias
    kind = whole.schema["segments"].dataType
    told = F.struct(none(F.col("segments"), kind)("segments"), none(flat, own.schema["words"].dataType)("word_segments"), "language")
    return languages.join(whole, "rec_id", "left").select("rec_id", F.to_json(told).alias("document"))


def _listed(name: str, order: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), value.alias("v")))), lambda x: x["v"]).alias(name)


WORD = "struct<word:string,start:double,end:double,confidence:double,speaker:string,channel:int>"
SEGMENTS = f"array<struct<id:bigint,start:double,end:double,text:string,channel:int,speaker:string,avg_confidence:double,words:array<{WORD}>>>"
SILENCE, SPEAKERS = "array<struct<start:double,end:double>>", "array<struct<id:string,total_speech:double,segments:bigint>>"
STATS = "struct<audio_duration:double,processing_ms:bigint,rtf:double,stages_ms:map<string,bigint>,segments_total:bigint,speech_ratio:double>"
WARNINGS = "array<struct<code:string,message:string>>"
RESULT = f"id bigint, model string, language string, duration double, text string, timestamp_source string, segments {SEGMENTS}, silence {SILENCE}, speakers {SPEAKERS}, stats {STATS}, warnings {WARNINGS}"


def result_json(recordings: DataFrame, segments: DataFrame, words: DataFrame, silence: DataFrame) -> DataFrame:
    """(rec_id, result): the whole nested transcript of each recording; fields that are null are left out, as are empty speakers and warnings.

    Recordings have rec_id, model, language, timestamp_source, duration_ms, processing_ms, stages_ms (a map) and warnings (an array
    of code and message); one without segments has empty lists. The text joins the segments that aren't blank. Speech is the
    time that ``silence`` leaves, none without segments; ratios are 0 where the duration is.
    """
    seconds = lambda c: F.col(c) / 1000
    share = lambda part, of: F.when(F.col(of) > 0, F.round(part / F.col(of), 6)).otherwise(F.lit(0.0))
    w = F.struct("word", seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), seconds("conf_milli").alias("confidence"), "speaker", "channel")
    own = words.groupBy("rec_id", "id").agg(_listed("words", "seq", w))
    s = F.struct("id", seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), "text", "channel", "speaker", F.col("avg_conf").alias("avg_confidence"), "words")
    whole = meet(segments, own, ["rec_id", "id"]).groupBy("rec_id").agg(_listed("segments", "id", s))
    voices = segments.where("speaker IS NOT NULL").groupBy("rec_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.count("*").alias("segments"))
    voices = voices.groupBy("rec_id").agg(_listed("speakers", "speaker", F.struct(F.col("speaker").alias("id"), seconds("ms").alias("total_speech"), "segments")))
    gaps = silence.groupBy("rec_id").agg(_listed("silence", "start_ms", F.struct(seconds("start_ms").alias("start"), seconds("end_ms").alias("end"))), F.sum(F.col("end_ms") - F.col("start_ms")).alias("quiet"))
    all_ = recordings.join(whole, "rec_id", "left").join(gaps, "rec_id", "left").join(voices, "rec_id", "left")
    spoken = F.filter(F.transform("segments", lambda x: F.trim(x["text"])), lambda t: t != "")
    stats = F.struct(
        seconds("duration_ms").alias("audio_duration"), "processing_ms", share(F.col("processing_ms"), "duration_ms").alias("rtf"), "stages_ms",
        F.coalesce(F.size("segments"), F.lit(0)).cast("long").alias("segments_total"), F.when(F.size("segments") > 0, share(F.col("duration_ms") - F.coalesce("quiet", F.lit(0)), "duration_ms")).otherwise(0.0).alias("speech_ratio"),
    )
    empty = lambda c: F.coalesce(c, F.array().cast(all_.schema[c].dataType)).alias(c)
    told = F.struct(
        F.col("rec_id").alias("id"), "model", "language", seconds("duration_ms").alias("duration"), F.coalesce(F.array_join(spoken, " "), F.lit("")).alias("text"), "timestamp_source",
        empty("segments"), empty("silence"), "speakers", stats.alias("stats"), F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings"),
    )
    return all_.withColumn("segments", F.when(F.size("segments") >= 0, F.col("segments"))).select("rec_id", F.to_json(told).alias("result"))


def read_transcripts(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, segments and silence of nested transcripts (rec_id, result); words are numbered in segment order."""
    doc = results.select("rec_id", F.from_json("result", RESULT).alias("r"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    s = doc.select("rec_id", F.posexplode("r.segments").alias("at", "s"))
    segments = s.select("rec_id", "s.id", "s.channel", "s.speaker", ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), "s.text", F.col("s.avg_confidence").alias("avg_conf"))
    w = s.select("rec_id", "at", "s.id", F.posexplode("s.words").alias("pos", "w"))
    seq = F.row_number().over(Window.partitionBy("rec_id").orderBy("at", "pos")) - 1
    words = w.select("rec_id", "id", seq.alias("seq"), "w.word", ms("w.start").alias("start_ms"), ms("w.end").alias("end_ms"), ms("w.confidence").alias("conf_milli"), "w.speaker", "w.channel")
    silence = doc.select("rec_id", F.inline("r.silence")).select("rec_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"))
    return words, segments, silence


def read_summaries(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recordings, speakers and warnings of nested transcripts (rec_id, result).

    Each recording has one row (rec_id, model, language, duration_ms, text, timestamp_source, n_segments, processing_ms,
    rtf, speech_ratio, stages_ms), also one without segments; what doesn't parse has nulls. Speakers are (rec_id, speaker, speech_ms, segments),
    warnings (rec_id, ord, code, message).
    """
    doc = results.select("rec_id", F.from_json("result", RESULT).alias("r"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    whole = doc.select("rec_id", "r.model", "r.language", ms("r.duration").alias("duration_ms"), "r.text", "r.timestamp_source", F.size("r.segments").alias("n_segments"), "r.stats.processing_ms", "r.stats.rtf", "r.stats.speech_ratio", "r.stats.stages_ms")
    speakers = doc.select("rec_id", F.inline("r.speakers")).select("rec_id", F.col("id").alias("speaker"), ms("total_speech").alias("speech_ms"), "segments")
    return whole, speakers, doc.select("rec_id", F.posexplode("r.warnings").alias("ord", "w")).select("rec_id", "ord", "w.code", "w.message")
