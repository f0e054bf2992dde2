"""Scalar functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_ms(ms: Column, mark: str, hours: bool) -> Column:
    """hh:mm:ss or mm:ss, then the mark and milliseconds, of whole milliseconds."""
    h, m, s, rest = F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h, m, s, rest) if hours else F.format_string(f"%02d:%02d{mark}%03d", m, s, rest)


def timecode_trunc(seconds: Column, mark: str = ",") -> Column:
    """hh:mm:ss,mmm with milliseconds cut off; negative times are 0."""
    return clock_ms(F.floor(F.greatest(seconds, F.lit(0.0)) * 1000), mark, True)


def millis(seconds: Column) -> Column:
    """Whole milliseconds, halves to even; 0 for times up to 0."""
    return F.when(seconds <= 0, F.lit(0)).otherwise(F.bround(seconds * 1000)).cast("long")


def timecode_even(seconds: Column, mark: str = ",", always_hours: bool = True) -> Column:
    """A time code of half-even milliseconds; below an hour, hours may be left out."""
    ms = millis(seconds)
    return clock_ms(ms, mark, True) if always_hours else F.when(ms >= 3_600_000, clock_ms(ms, mark, True)).otherwise(clock_ms(ms, mark, False))


def milli_round(x: Column) -> Column:
    """Three decimals, halves away from zero."""
    return F.round(x, 3)


def round2(x: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(x, 2)


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; fractions are cut off."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)))
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def human_bytes(n: Column) -> Column:
    """A size in B, KB, MB, GB or TB by 1024, with one decimal below 10 beyond B."""
    out = F.format_string("%d B", n)
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = n / float(1024**power)
        text = F.when(scaled < 10, F.format_string(f"%.1f {unit}", scaled)).otherwise(F.format_string(f"%d {unit}", F.round(scaled).cast("long")))
        out = F.when(n >= 1024**power, text).otherwise(out)
    return out


def base_tag(tag: Column) -> Column:
    """A language tag up to its first hyphen."""
    return F.substring_index(tag, "-", 1)


def base_id(model: Column) -> Column:
    """A model key up to its revision mark."""
    return F.substring_index(model, "@", 1)


def model_key(model: Column, revision: Column) -> Column:
    """id, or id@revision where there is one."""
    return F.when(F.coalesce(revision, F.lit("")) == "", model).otherwise(F.concat(model, F.lit("@"), revision))


def speaker_name_clean(name: Column) -> Column:
    """A name without control characters and outer blanks; null beyond 64 characters."""
    out = F.trim(F.regexp_replace(name, r"\p{Cc}", ""))
    return F.when(F.length(out) <= 64, out)


def file_safe(name: Column) -> Column:
    """A file name with control characters and path marks replaced."""
    return F.regexp_replace(name, r'[\p{Cc}/\\:*?"<>|]', "_")


def result_name(path: Column) -> Column:
    """The name of a recording's voice track: its file name without folders and ending, made safe."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\\\]", ""), r"(?<=.)\.[^.]*$", "")
    return F.concat(file_safe(stem), F.lit("-voice"))


def word_key(word: Column) -> Column:
    """Letters and digits of a word in lower case: what two tracks have in common."""
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{Nd}]", ""))


def text_delta(previous: Column, current: Column) -> Column:
    """What a partial text adds: the rest if it extends the last one, all after an empty one, else nothing."""
    return F.when(previous == "", current).when(current.startswith(previous), F.substr(current, F.length(previous) + 1)).otherwise(F.lit(""))


def power_db(power: Column) -> Column:
    return 10 * F.log10(power + 1e-12)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def l2_normalise(a: Column) -> Column:
    """An array scaled to length 1; zeros stay."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.transform(a, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(F.lit(0.0)))


def rms(a: Column) -> Column:
    """Root mean square of an array; 0 of an empty one."""
    return F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(a))).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, at most 1; 0 where there is no whole."""
    return F.when(whole > 0, F.least(F.lit(1.0), part / whole)).otherwise(F.lit(0.0))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def joins(end_ms: Column, next_start_ms: Column, most_ms: int = 350) -> Column:
    """Do two words belong together: is the pause between them short enough?"""
    return next_start_ms - end_ms <= most_ms


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length that two intervals share; touching shares nothing."""
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def cursor_encode(created_ms: Column, key: Column) -> Column:
    """A page cursor: base64url of ms:id, without padding."""
    raw = F.base64(F.concat_ws(":", created_ms.cast("string"), key).cast("binary"))
    return F.rtrim(F.translate(raw, "+/\r\n", "-_"), F.lit("="))


def cursor_decode(cursor: Column) -> Column:
    """(created_ms, id) of a cursor, null where it is malformed."""
    padded = F.rpad(F.translate(cursor, "-_", "+/"), F.ceil(F.length(cursor) / 4) * 4, F.lit("="))
    plain = F.when(cursor.rlike("^[A-Za-z0-9_-]+$") & (F.length(cursor) % 4 != 1), F.unbase64(padded).cast("string"))
    at, key = F.regexp_extract(plain, r"^(\d{1,18}):(.+)$", 1), F.regexp_extract(plain, r"^(\d{1,18}):(.+)$", 2)
    return F.when(F.length(at) > 0, F.struct(at.cast("long").alias("created_ms"), key.alias("id")))


def variant_key(*fields: Column) -> Column:
    """Twelve hex digits that name a set of fields: SHA-256 over length, NUL and bytes of each; '' if all are empty."""
    parts = F.concat(*(F.concat(F.octet_length(f).cast("string").cast("binary"), F.lit(b"\0"), f.cast("binary")) for f in fields))
    return F.when(F.concat(*fields) == "", F.lit("")).otherwise(F.substring(F.sha2(parts, 256), 1, 12))


def trim_punct(word: Column) -> tuple[Column, Column]:
    """A word without its trailing . , ! ? ; : and those marks."""
    stem = F.regexp_replace(word, "[.,!?;:]+$", "")
    return stem, F.substr(word, F.length(stem) + 1)


def stage_percent(stage: Column) -> Column:
    """Progress that a stage stands for."""
    known = F.create_map(*(F.lit(x) for kv in {"decode": 10, "vad": 25, "asr": 40, "assemble": 95}.items() for x in kv))
    return F.coalesce(known[stage], F.lit(0))


def logprob(conf: Column) -> Column:
    """Natural logarithm of a confidence, 0 where there is none."""
    return F.when(conf > 0, F.ln(conf)).otherwise(F.lit(0.0))


def timeline_percent(t: Column, duration: Column) -> Column:
    """Place on a timeline in percent, inside 0..100; a zero duration counts as 1."""
    return F.least(F.greatest(t / F.when(duration == 0, 1).otherwise(duration) * 100, F.lit(0.0)), F.lit(100.0))


def is_special_token(token: Column) -> Column:
    """<...> tokens, with or without the word mark before them."""
    return F.regexp_replace(token, "^▁", "").rlike("(?s)^<.*>$")


def is_punctuation(word: Column) -> Column:
    """Not empty, and all of it punctuation or symbols."""
    return word.rlike(r"^[\p{P}\p{S}]+$")


def valid_key(key: Column) -> Column:
    """(key, reason): a dictionary key trimmed and in lower case, or why it isn't one."""
    k = F.lower(F.trim(key))
    reason = F.when(k == "", "empty").when(F.length(k) > 64, "too long").when(~k.rlike("^[a-z0-9][a-z0-9_-]*$"), "bad character")
    return F.struct(F.when(reason.isNull(), k).alias("key"), reason.alias("reason"))
