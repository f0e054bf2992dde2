"""Words from recogniser tokens, repairs of a word stream, and as-of lookups in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions.scalar import is_punctuation, is_special_token
from tidewords.operators.patterns import asof_last, before, islands, meet, up_to

#: Tokenisation units; anything else reads as ``bpe``.
BPE, CHAR, CJK, CJK_BPE = "bpe", "char", "cjkchar", "cjkchar+bpe"
_CJK = r"^▁?[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def opens_word(token: Column, unit: str) -> Column:
    """Does a token begin a word under a unit?"""
    marked = token.startswith("▁") | token.startswith(" ")
    if unit == CJK:
        return F.lit(True)
    return marked | token.rlike(_CJK) if unit == CJK_BPE else F.lit(False) if unit == CHAR else marked


def assemble_words(tokens: DataFrame, keys: list[str], unit: str = BPE) -> DataFrame:
    """Words of tokens (keys, k, token, ts_ms, dur_ms, logprob, seg_ms), in order of k, by segment.

    A token lasts its duration if that is known, else until the next token, else to the segment's end. Special
    tokens are dropped, words that are blank go, times stay inside 0..seg_ms; confidence is exp of the mean log
    probability. Under ``char``, blank tokens part words and belong to none.
    """
    at = Window.partitionBy(*keys).orderBy("k")
    t = tokens.withColumn("__next", F.lead("ts_ms").over(at)).where(~is_special_token(F.col("token")))
    blank = F.trim(F.replace("token", F.lit("▁"))) == ""
    if unit == CHAR:
        t = t.withColumn("__blank", blank)
        t = islands(t, keys, ["k"], F.col("__blank"), "__word").where(~F.col("__blank"))
    else:
        t = islands(t, keys, ["k"], opens_word(F.col("token"), unit), "__word")
    end = F.when(F.col("dur_ms") > 0, F.col("ts_ms") + F.col("dur_ms")).otherwise(F.coalesce("__next", "seg_ms"))
    pieces = F.array_sort(F.collect_list(F.struct("k", "token")))
    text = F.trim(F.replace(F.array_join(F.transform(pieces, lambda p: p["token"]), ""), F.lit("▁")))
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.max("seg_ms"))
    words = t.withColumn("__end", end).groupBy(*keys, "__word").agg(
        text.alias("word"), inside(F.min_by("ts_ms", "k")).alias("start_ms"), inside(F.max_by("__end", "k")).alias("end_ms"), F.coalesce(F.exp(F.avg("logprob")), F.lit(0.0)).alias("conf"), F.min("k").alias("k")
    )
    return words.where("word <> ''").withColumn("end_ms", F.greatest("start_ms", "end_ms")).drop("__word")


def segment_fallback(segments: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words, with one of a segment's whole text and time for each segment that has none; and (rec_id, timestamp_source, warning).

    Where no segment of a recording has words with times, its source is the segments and it gets a warning.
    """
    bare = segments.join(words.select("rec_id", "id").distinct(), ["rec_id", "id"], "left_anti")
    made = bare.where(F.trim("text") != "").select("rec_id", "id", F.lit(0).cast("long").alias("seq"), F.trim("text").alias("word"), "start_ms", "end_ms")
    timed = segments.select("rec_id").distinct().join(words.select("rec_id").distinct().withColumn("timed", F.lit(True)), "rec_id", "left")
    told = timed.select("rec_id", F.when(F.col("timed"), "token").otherwise("segment").alias("timestamp_source"), F.when(F.col("timed").isNull(), "word_timestamps_unavailable").alias("warning"))
    return words.select(*made.columns).unionByName(made), told


def scatter_words(outputs: DataFrame, layout: DataFrame) -> DataFrame:
    """Output words (rec_id, ord, span, …) with the segment (id) that owns their first input word.

    ``layout`` has (rec_id, id, n): the input words of each segment in order. Spans say how many inputs an output covers.
    """
    at = F.coalesce(F.sum("span").over(before(["rec_id"], ["ord"])), F.lit(0))
    begins = layout.where("n > 0").withColumn("__from", F.coalesce(F.sum("n").over(before(["rec_id"], ["id"])), F.lit(0)))
    return asof_last(begins, outputs.withColumn("__place", at), "rec_id", "__from", "__place", ["id"], "id").drop("__place")


def compose_spans(first: DataFrame, second: DataFrame) -> DataFrame:
    """(rec_id, ord, span) of two stages run one after the other: how many of the first's inputs the second's outputs cover."""
    ends = second.withColumn("__to", F.sum("span").over(up_to(["rec_id"], ["ord"])))
    owners = asof_last(ends.select("rec_id", (-F.col("__to")).alias("__s"), F.col("ord").alias("owner")), first.select("rec_id", "span", (-F.col("ord") - 1).alias("__t")), "rec_id", "__s", "__t", ["owner"], "owner")
    return owners.groupBy("rec_id", F.col("owner").alias("ord")).agg(F.sum("span").alias("span"))


#: A letter or digit; and one with the marks that go with it: those that follow without a blank, and those after a blank before it.
_LETTER, _BLANKS = r"[\p{L}\p{Nd}]", r"[\s\p{Z}\x85]+"
_UNIT = r"[^\p{L}\p{Nd}]*+(?:[\p{L}\p{Nd}][^\p{L}\p{Nd}\s\p{Z}\x85]*+|$)"


def reattach_text(words: DataFrame, punctuated: DataFrame, keys: list[str]) -> DataFrame:
    """Words (keys, seq, word) as written in the punctuated text (keys, punctuated) of their chunk.

    Letters and digits of both sides are numbered. If each agrees but for case, and none of the
    punctuated text's is missing up to the last word's, each character of the text goes to the word whose letter it is, whose letter it
    follows without a blank, or, failing that, whose letter comes next; else the chunk keeps its words. Null texts
    and words without letters keep the chunk too. A chunk's words are one array, next to its text.
    """
    rest = [c for c in words.columns if c not in keys]
    every = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    letters = lambda c: F.transform(every(c, _LETTER), F.lower)
    counted = words.withColumn("__l", letters(F.coalesce("word", F.lit("")))).withColumn("__n", F.size("__l"))
    counted = counted.withColumn("__to", F.sum("__n").over(up_to(keys, ["seq"])).cast("int"))
    item = F.struct(F.col("seq").alias("__seq"), "__l", "__n", "__to", F.struct(*rest).alias("r"))
    met = meet(counted.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__ws")), punctuated.select(*keys, "punctuated"), keys)
    said = F.flatten(F.transform("__ws", lambda x: x["__l"]))
    met = met.withColumns({"__said": said, "__wrote": letters(F.col("punctuated")), "__units": F.transform(every(F.col("punctuated"), _UNIT), lambda u: F.regexp_replace(u, _BLANKS, ""))})
    agrees = F.forall("__ws", lambda x: x["__n"] > 0) & (F.slice("__wrote", F.lit(1), F.size("__said")) == F.col("__said"))
    met = met.withColumn("__agrees", F.coalesce(agrees, F.lit(False)))

    def written(x):
        mine = F.array_join(F.slice("__units", x["__to"] - x["__n"] + 1, x["__n"]), "")
        return F.struct(*((F.when(F.col("__agrees"), mine).otherwise(x["r"]["word"]) if c == "word" else x["r"][c]).alias(c) for c in rest))

    return met.select(*keys, F.inline(F.transform("__ws", written))).select(*words.columns)


def punctuation_stage(model: Callable[[DataFrame], DataFrame], most: int = 200):
    """A stage that asks a model for the punctuated text of chunks of ``most`` words and gives words its marks and case.

    The model maps words (rec_id, channel, chunk, seq, word) to (rec_id, channel, chunk, punctuated).
    """
    from tidewords.operators.stages import STREAM, Stage

    def apply(words: DataFrame) -> DataFrame:
        number = F.row_number().over(Window.partitionBy(*STREAM).orderBy("seq")) - 1
        chunks = words.withColumn("chunk", F.floor(number / most))
        done = reattach_text(chunks, model(chunks.select(*STREAM, "chunk", "seq", "word")), [*STREAM, "chunk"])
        return done.drop("chunk").withColumn("span", F.lit(None).cast("long"))

    return Stage("punctuation", apply)


def merge_punctuation(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Words of punctuation alone join the word before them; one at the start stays. Returns keys, order, word, start_ms, end_ms."""
    at = Window.partitionBy(*keys).orderBy(order)
    stands = ~is_punctuation(F.col("word")) | (F.row_number().over(at) == 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "word"))), lambda x: x["word"]), "")
    return islands(words, keys, [order], stands, "__w").groupBy(*keys, "__w").agg(F.min(order).alias(order), text.alias("word"), F.min_by("start_ms", order).alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("__w")


def enforce_monotonic(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each end is cut to the next start, but not below its own start; the last word is left alone."""
    following = F.lead("start_ms").over(Window.partitionBy(*keys).orderBy(order))
    return words.withColumn("__next", following).withColumn("end_ms", F.when(F.col("__next").isNull(), F.col("end_ms")).otherwise(F.greatest(F.least("end_ms", "__next"), "start_ms"))).drop("__next")


def retime(segments: DataFrame, words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Segments widened to their words (joined by ``keys``), then pushed so that none starts before the last end.

    In closed form a segment's end is the running maximum of ends and starts, and its start the greater of its
    own and the end before; the first segment's times are only widened.
    """
    edges = words.groupBy(*keys).agg(F.min_by("start_ms", "wid").alias("__a"), F.max_by("end_ms", "wid").alias("__b"))
    s = segments.join(edges, keys, "left").withColumn("start_ms", F.least("start_ms", "__a")).withColumn("end_ms", F.greatest("end_ms", "__b")).drop("__a", "__b")
    own = Window.partitionBy("rec_id").orderBy(order)
    first = F.row_number().over(own) == 1
    s = s.withColumn("__first", first)
    s = s.withColumn("__push", F.when(F.col("__first"), F.col("end_ms")).otherwise(F.greatest("start_ms", "end_ms")))
    s = s.withColumn("__reach", F.max("__push").over(up_to(["rec_id"], [order]))).withColumn("__last", F.max("__push").over(before(["rec_id"], [order])))
    return s.withColumn("start_ms", F.greatest("start_ms", "__last")).withColumn("end_ms", F.when(F.col("__first"), F.col("end_ms")).otherwise(F.col("__reach"))).drop("__first", "__push", "__reach", "__last")


def chunks_with_overlap(words: DataFrame, keys: list[str], order: str, size: int = 200, lead: int = 20) -> DataFrame:
    """Rows (keys, chunk, order, owned): chunk i owns words i*size.. and sees ``lead`` words before them."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    w = words.withColumn("__n", n).withColumn("__own", F.floor(F.col("__n") / size)).withColumn("__total", F.count("*").over(Window.partitionBy(*keys)))
    ahead = (F.col("__n") % size >= size - lead) & ((F.col("__own") + 1) * size < F.col("__total"))
    chunks = F.explode(F.when(ahead, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own")))
    return w.withColumn("chunk", chunks).select(*keys, "chunk", order, (F.col("chunk") == F.col("__own")).alias("owned"))


def merge_channels(segments: DataFrame) -> DataFrame:
    """Segments of all channels by start, channel and old order, numbered anew as ``id``."""
    order = Window.partitionBy("rec_id").orderBy("start_ms", "channel", "turn", "sn")
    return segments.withColumn("id", F.row_number().over(order) - 1)


def words_at(words: DataFrame, asked: DataFrame, tolerance: int = 10) -> DataFrame:
    """asked (rec_id, t) with wid: the last word that has begun, if it hasn't ended (by ``tolerance`` ms); -1 if none."""
    found = asof_last(words.withColumn("__s", F.col("start_ms") - tolerance), asked, "rec_id", "__s", "t", ["wid", "end_ms"], "wid")
    return found.select("rec_id", "t", F.when(F.col("t") <= F.col("end_ms") + tolerance, F.col("wid")).otherwise(-1).alias("wid"))


def neighbours(words: DataFrame, asked: DataFrame, step: int = 1) -> DataFrame:
    """asked (rec_id, t) with previous and next: the last word starting before t - step, the first after t + step; -1 if none."""
    w = words.select("rec_id", "wid", "start_ms")
    back = asof_last(w.withColumn("__s", F.col("start_ms") + step + 1), asked, "rec_id", "__s", "t", ["wid"], "wid").withColumnRenamed("wid", "previous")
    mirrored = w.select("rec_id", "wid", (step + 1 - F.col("start_ms")).alias("__s"), (-F.col("wid")).alias("__tie"))
    both = asof_last(mirrored, back.withColumn("__t", -F.col("t")), "rec_id", "__s", "__t", ["wid"], "__tie")
    return both.select("rec_id", "t", "previous", F.col("wid").alias("next")).na.fill(-1, ["previous", "next"])
