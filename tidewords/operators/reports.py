"""Figures, warnings and decisions about recordings, models and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions.scalar import base_tag
from tidewords.operators.spans import merge_spans

#: Names of languages by their code.
LANGUAGES = {"multi": "multilingual", "ar": "arabic", "be": "belarusian", "bg": "bulgarian", "cs": "czech", "da": "danish", "de": "german", "el": "greek", "en": "english", "es": "spanish", "et": "estonian", "fa": "persian", "fi": "finnish", "fr": "french", "he": "hebrew", "hi": "hindi", "hu": "hungarian", "hy": "armenian", "id": "indonesian", "it": "italian", "ja": "japanese", "ka": "georgian", "kk": "kazakh", "ko": "korean", "lt": "lithuanian", "lv": "latvian", "nl": "dutch", "no": "norwegian", "pl": "polish", "pt": "portuguese", "ro": "romanian", "ru": "russian", "sk": "slovak", "sl": "slovenian", "sr": "serbian", "sv": "swedish", "tr": "turkish", "uk": "ukrainian", "uz": "uzbek", "vi": "vietnamese", "zh": "chinese"}
#: What a file of a format begins with, as hexadecimal digits at a byte offset.
MAGIC = (("wav", 0, "52494646"), ("flac", 0, "664C6143"), ("ogg", 0, "4F676753"), ("mp3", 0, "494433"), ("mp4", 4, "66747970"), ("amr", 0, "2321414D520A"), ("mkv", 0, "1A45DFA3"), ("caf", 0, "63616666"), ("au", 0, "2E736E64"))


def audio_stats(spans: DataFrame, channels: DataFrame, processing: DataFrame) -> DataFrame:
    """(rec_id, duration_ms, speech_ratio, rtf): the longest channel, the share of it with speech on any, and time spent over it."""
    longest = channels.groupBy("rec_id").agg(F.max("total").alias("duration_ms"))
    speech = merge_spans(spans.select("rec_id", "s", "e")).groupBy("rec_id").agg(F.sum(F.col("e") - F.col("s")).alias("speech"))
    met = longest.join(speech, "rec_id", "left").join(processing, "rec_id", "left")
    over = lambda c: F.when(F.col("duration_ms") > 0, F.coalesce(c, F.lit(0)) / F.col("duration_ms")).otherwise(F.lit(0.0))
    return met.select("rec_id", "duration_ms", over(F.col("speech")).alias("speech_ratio"), over(F.col("processing_ms")).alias("rtf"))


def merge_stage_stats(parts: DataFrame) -> DataFrame:
    """(rec_id, stages): the maps (stage to ms) of a recording's parts added up key by key."""
    summed = parts.select("rec_id", F.explode("stages").alias("stage", "ms")).groupBy("rec_id", "stage").agg(F.sum("ms").alias("ms"))
    return summed.groupBy("rec_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "ms")))).alias("stages"))


def merge_warnings(rows: DataFrame, last: bool = False) -> DataFrame:
    """(rec_id, place, code, message): each code once, where it came first, with its first or last message."""
    pick = F.max_by if last else F.min_by
    first = rows.groupBy("rec_id", "code").agg(F.min("ord").alias("ord"), pick("message", "ord").alias("message"))
    return first.select("rec_id", (F.row_number().over(Window.partitionBy("rec_id").orderBy("ord")) - 1).alias("place"), "code", "message")


def transcript_progress(tracks: DataFrame) -> DataFrame:
    """(rec_id, percent): the mean of the tracks' percents, cut off; one that has succeeded counts 100."""
    return tracks.groupBy("rec_id").agg(F.expr("sum(if(status = 'succeeded', 100, percent)) div greatest(1, count(*))").alias("percent"))


def diarization_warnings(rows: DataFrame) -> DataFrame:
    """Rows (asked, found, takes_count) with the warning that too few or too many speakers were found."""
    fewer = (F.col("asked") > 1) & (F.col("found") < F.col("asked"))
    more = (F.col("asked") > 0) & (F.col("found") > F.col("asked")) & ~F.col("takes_count")
    return rows.withColumn("warning", F.when(fewer, "diarization_fewer_speakers").when(more, "diarization_more_speakers"))


def result_warnings(rows: DataFrame) -> DataFrame:
    """Rows (segments, timed, asked and possible of punctuation and itn) with timestamp_source and an array of warning codes."""
    spoken = F.col("segments") > 0
    codes = F.array_compact(
        F.array(
            F.when(~spoken, "no_speech_detected"),
            F.when(spoken & ~F.col("timed"), "word_timestamps_unavailable"),
            *(F.when(F.col(f"{kind}_asked") & ~F.col(f"{kind}_possible"), f"{kind}_unavailable") for kind in ("punctuation", "itn")),
        )
    )
    return rows.withColumn("timestamp_source", F.when(spoken & ~F.col("timed"), "segment").otherwise("token")).withColumn("warnings", codes)


def strict_reject(rows: DataFrame) -> DataFrame:
    """Rows with ``error``: the first of their warning codes that tells of something left undone."""
    return rows.withColumn("error", F.get(F.filter("warnings", lambda w: w.endswith("_unavailable") | (w == "language_mismatch")), F.lit(0)))


def check_spans(rows: DataFrame) -> DataFrame:
    """What is wrong with stages (stage, inputs, outputs, spans): how outputs cover inputs; sound ones don't come back."""
    total = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x)
    wrong = (
        F.when(F.col("spans").isNull(), F.when(F.col("inputs") != F.col("outputs"), "counts differ without spans"))
        .when(F.size("spans") != F.col("outputs"), "a span is missing")
        .when(F.exists("spans", lambda x: x < 1), "an output covers nothing")
        .when(total != F.col("inputs"), "inputs are left over")
    )
    return rows.withColumn("violation", wrong).where("violation IS NOT NULL")


def _tag(c: Column) -> Column:
    return F.lower(F.replace(F.trim(c), F.lit("_"), F.lit("-")))


def resolve_locale(requests: DataFrame, locales: Column) -> DataFrame:
    """``requests`` (lang, …) with locale: auto, the listed locale itself, or the first of a bare code; null if there is none."""
    want = F.when(_tag(F.col("lang")) == "no", "nb").otherwise(_tag(F.col("lang")))
    held = requests.withColumn("__want", want).withColumn("__listed", locales)
    exact = F.get(F.filter("__listed", lambda x: F.lower(x) == F.col("__want")), F.lit(0))
    base = F.when(~F.col("__want").contains("-"), F.get(F.filter("__listed", lambda x: base_tag(_tag(x)) == F.col("__want")), F.lit(0)))
    return held.withColumn("locale", F.when(F.col("__want").isin("", "auto"), "auto").otherwise(F.coalesce(exact, base))).drop("__want", "__listed")


def language_name(code: Column, declared: Column) -> tuple[Column, Column]:
    """The name of a language by its code or base, else the code; and confidence 1 only where a model declares just one."""
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(names, code), F.try_element_at(names, base_tag(_tag(code))), code), F.when(F.size(declared) == 1, 1.0).otherwise(0.0)


def language_supported(rows: DataFrame) -> DataFrame:
    """Rows (languages, locales, multilingual, lang) with supported: always for auto, by locale, or by base tags."""
    single = F.exists("languages", lambda x: (x == "multi") | (base_tag(_tag(x)) == base_tag(_tag(F.col("lang")))))
    resolved = resolve_locale(rows, F.col("locales"))
    return resolved.withColumn("supported", F.when(_tag(F.col("lang")).isin("", "auto"), True).when(F.col("multilingual"), F.col("locale").isNotNull()).otherwise(single)).drop("locale")


def hotword_capability(models: DataFrame) -> DataFrame:
    """Models (family, method, unit, has_vocab) with reason: why phrases can't be favoured, null where they can; and decoding."""
    reason = (
        F.when(F.col("family") == "streaming_transducer", "streaming")
        .when(F.col("family") != "transducer", "family")
        .when(F.col("method") != "modified_beam_search", "decoding")
        .when(F.col("unit") == "cjkchar", F.lit(None).cast("string"))
        .when(F.col("unit").isin("bpe", "cjkchar+bpe"), F.when(~F.col("has_vocab"), "vocabulary"))
        .otherwise("unit")
    )
    decoding = F.when(F.col("method").isin("", "greedy_search"), True).when(F.col("method") == "modified_beam_search", F.col("family").isin("transducer", "streaming_transducer")).otherwise(False)
    return models.withColumns({"reason": reason, "decodes": decoding})


def not_installed(catalog: DataFrame, local: DataFrame) -> DataFrame:
    return catalog.join(local.select("model_id"), "model_id", "left_anti")


def media_inventory(files: DataFrame) -> DataFrame:
    """(format, files, bytes): files (content) by what they begin with."""
    head = F.hex(F.substring("content", 1, 16))
    starts = lambda at, sign: F.substring(head, 2 * at + 1, len(sign)) == sign
    kind = F.lit("unknown")
    for name, at, sign in reversed(MAGIC):
        known = starts(at, sign) & starts(8, "57415645") if name == "wav" else starts(at, sign)
        kind = F.when(starts(0, "FF") & F.substring(head, 3, 1).isin("E", "F") & (F.lit(name) == "mp4"), "mp3").when(known, name).otherwise(kind)
    return files.select(kind.alias("format"), F.octet_length("content").alias("n")).groupBy("format").agg(F.count("*").alias("files"), F.sum("n").cast("long").alias("bytes"))


def read_vocabulary(lines: DataFrame) -> DataFrame:
    """(model, token, id) of lines (model, line): the last blank parts a token, which may be a blank itself, from its number."""
    at = lambda k: F.regexp_extract("line", r"(?s)^(.*) ([^ ]*)$", k)
    return lines.select("model", at(1).alias("token"), at(2).cast("long").alias("id"))


def modeling_unit(tokens: DataFrame) -> DataFrame:
    """(model, unit): how a vocabulary writes words, from the shares of marked, single and CJK tokens; special tokens aside."""
    t = tokens.where((F.trim("token") != "") & ~F.col("token").rlike("^<.*>$"))
    bare = F.replace("token", F.lit("▁"))
    count = lambda cond: F.count_if(cond)
    sums = t.groupBy("model").agg(F.count("*").alias("n"), count(F.col("token").contains("▁")).alias("marked"), count(F.length(bare) == 1).alias("single"), count(bare.rlike(r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]$")).alias("cjk"))
    unit = F.when((F.col("marked") > 0) & (4 * F.col("cjk") > F.col("n")), "cjkchar+bpe").when(F.col("marked") > 0, "bpe").when(2 * F.col("cjk") > F.col("n"), "cjkchar").when(10 * F.col("single") > 9 * F.col("n"), "char").otherwise("bpe")
    return sums.select("model", unit.alias("unit"))


def route_channels(rows: DataFrame) -> DataFrame:
    """Rows (diarize, mode, channels, enabled, segments) with route (none, split, diarize) and a warning."""
    split = (F.col("mode") == "split") & (F.col("channels") > 1)
    route = F.when(~F.col("diarize"), "none").when(split, "split").when(~F.col("enabled") | (F.col("segments") == 0), "none").otherwise("diarize")
    warning = F.when(F.col("diarize") & split, "diarization_skipped_split").when(F.col("diarize") & ~F.col("enabled"), "diarization_unavailable")
    return rows.withColumns({"route": route, "warning": warning})


def pack_batches(segments: DataFrame, most: int = 8, most_ms: int = 60_000) -> DataFrame:
    """Segments (rec_id, id, length_ms) with batch: filled in order up to so many and so long; a longer one stands alone.

    One fold over a recording's lengths finds where batches begin.
    """
    listed = segments.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("id", "length_ms"))).alias("ls"))

    def fill(acc, x):
        full = (acc["n"] == 0) | (acc["n"] >= most) | (acc["ms"] + x["length_ms"] > most_ms)
        return F.when(full, F.struct(F.lit(1).alias("n"), x["length_ms"].alias("ms"), F.concat(acc["begins"], F.array(x["id"])).alias("begins"))).otherwise(F.struct((acc["n"] + 1).alias("n"), (acc["ms"] + x["length_ms"]).alias("ms"), acc["begins"].alias("begins")))

    id_type = segments.schema["id"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast(segments.schema["length_ms"].dataType).alias("ms"), F.array().cast(f"array<{id_type}>").alias("begins"))
    begins = listed.select("rec_id", F.posexplode(F.aggregate("ls", start, fill, lambda acc: acc["begins"])).alias("batch", "id"))
    held = F.last("batch", ignorenulls=True).over(Window.partitionBy("rec_id").orderBy("id"))
    return segments.join(begins, ["rec_id", "id"], "left").withColumn("batch", held)


def gate_by_speaker(windows: DataFrame, references: DataFrame, least: float = 0.25) -> DataFrame:
    """Windows (rec_id, window, speaker, embedding) with own: close enough to their speaker's reference and to no other of the recording more.

    References (rec_id, speaker, embedding) are joined by recording, so that a window meets its own recording's few
    speakers; cosines are worked out on the pairs and summed up by window. Windows whose speaker has no reference aren't own.
    """
    from tidewords.functions.scalar import cosine

    refs = references.select("rec_id", F.col("speaker").alias("__who"), F.col("embedding").alias("__ref"))
    met = windows.join(refs, "rec_id", "left").withColumn("__c", cosine(F.col("__ref"), F.col("embedding")))
    mine = F.max(F.when(F.col("__who") == F.col("speaker"), F.col("__c")))
    best = F.coalesce(F.max(F.when(F.col("__who") != F.col("speaker"), F.col("__c"))), F.lit(-2.0))
    own = F.coalesce((mine >= least) & ~(best > mine), F.lit(False))
    return met.groupBy("rec_id", "window").agg(F.first("speaker").alias("speaker"), F.first("embedding").alias("embedding"), own.alias("own"))
