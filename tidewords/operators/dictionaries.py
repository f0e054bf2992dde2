"""Operators on phrase dictionaries: rows of (dict_key, ord, phrase)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions.scalar import valid_key
from tidewords.operators.patterns import first_k


def holds(phrase: Column, q: str) -> Column:
    """Whether a phrase has the text asked for in it, in either case; signs have no special meaning."""
    return F.instr(F.lower(phrase), q.lower()) > 0


#: The longest key, name, description and phrase, the most phrases and the highest score.
LONGEST = {"name": 200, "description": 2000, "phrase": 200}
MOST_PHRASES, MOST_SCORE, LISTED = 5000, 10, 200
#: Words that head a column of phrases.
HEADERS = ("phrase", "phrases", "word", "words", "hotword", "hotwords", "term", "terms", "text")


def clean_phrases(phrases: DataFrame, most: int = MOST_PHRASES) -> tuple[DataFrame, DataFrame]:
    """Phrases (dict_key, ord, phrase) with single blanks, and (dict_key, reason) of the dictionaries refused.

    Blank phrases and all but the first of equal ones go. A phrase with a line break or over 200 characters (before
    blanks are joined), or more than ``most`` phrases, refuse the whole dictionary.
    """
    p = phrases.withColumn("phrase", F.regexp_replace("phrase", r"^\s+|\s+$", "")).where("phrase <> ''")
    reason = F.when(F.col("phrase").rlike(r"[\r\n]"), "line break").when(F.length("phrase") > LONGEST["phrase"], "long phrase")
    marked = p.withColumn("reason", reason).withColumn("phrase", F.regexp_replace("phrase", r"\s+", " "))
    distinct = marked.groupBy("dict_key", "phrase").agg(F.min("ord").alias("ord"), F.min(F.struct("ord", "reason")).alias("first"), F.min(F.when(F.col("reason").isNotNull(), F.struct("ord", "reason"))).alias("bad"))
    refused = distinct.groupBy("dict_key").agg(F.min("bad").alias("bad"), F.count("*").alias("n"))
    refused = refused.select("dict_key", F.coalesce(F.col("bad.reason"), F.when(F.col("n") > most, "too many phrases")).alias("reason")).where("reason IS NOT NULL")
    return distinct.select("dict_key", "ord", "phrase").join(refused, "dict_key", "left_anti"), refused


def clean_dictionaries(dicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionaries (key, name, description, score) in order, and those refused as (key, field, reason).

    Keys are trimmed and in lower case, a blank name is the key; the first bad field is told.
    """
    checked = dicts.withColumn("__key", valid_key(F.col("key"))).withColumns({"name": F.trim(F.coalesce("name", F.lit(""))), "description": F.trim(F.coalesce("description", F.lit("")))})
    checked = checked.withColumn("name", F.when(F.col("name") == "", F.col("__key.key")).otherwise(F.col("name")))
    why = lambda field, reason: F.struct(F.lit(field).alias("field"), reason.alias("reason"))
    bad = (
        F.when(F.col("__key.reason").isNotNull(), why("key", F.col("__key.reason")))
        .when(F.length("name") > LONGEST["name"], why("name", F.lit("too long")))
        .when(F.length("description") > LONGEST["description"], why("description", F.lit("too long")))
        .when(~F.coalesce(F.col("score").between(0, MOST_SCORE), F.lit(False)), why("score", F.lit("out of range")))
    )
    checked = checked.withColumn("__bad", bad)
    good = checked.where("__bad IS NULL").withColumn("key", F.col("__key.key")).drop("__key", "__bad")
    return good, checked.where("__bad IS NOT NULL").select("key", "__bad.field", "__bad.reason")


def read_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases (path, ord, phrase) of files (path, content), and (path, reason) of those that hold none or don't parse.

    A file that begins with [ is a JSON array of phrases, with { a JSON object that has them; any other has a phrase a
    line. There, lines that begin with # are comments, a single line that isn't blank is parted at commas, and a column
    heading on the very first line is left out. Each line is looked at once.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    f = files.withColumn("body", bare(F.col("content"))).withColumn("first", F.substring("body", 1, 1))
    heads = lambda p: F.lower(p).isin(*HEADERS)
    # a body without a line feed is the only line that isn't blank; it may still not be the first one
    numbered = F.transform(F.split("content", "\n"), lambda x, i: F.struct(bare(x).alias("p"), i.alias("i")))
    lines = F.transform(F.filter(numbered, lambda x: (x["p"] != "") & ~x["p"].startswith("#") & ~((x["i"] == 0) & heads(x["p"]))), lambda x: x["p"])
    parts = F.filter(F.transform(F.split("body", ","), bare), lambda p: p != "")
    headed = bare(F.substring_index("content", "\n", 1)) != ""
    line = F.when(headed, F.filter(parts, lambda p: ~heads(p))).otherwise(parts)
    text = F.when(F.col("body").contains("\n"), lines).when(F.col("first") == "#", F.array().cast("array<string>")).otherwise(line)
    listed = F.when(F.col("first") == "[", F.from_json("body", "array<string>")).when(F.col("first") == "{", F.from_json("body", "phrases array<string>")["phrases"]).otherwise(text)
    read = f.withColumn("phrases", listed)
    reason = F.when(F.col("phrases").isNull(), "doesn't parse").when(F.size("phrases") == 0, "no phrases")
    return read.select("path", F.posexplode("phrases").alias("ord", "phrase")), read.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def upsert(base: DataFrame, phrases: DataFrame, incoming: DataFrame, new_phrases: DataFrame, now_ms: int, must_be_new: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dictionaries and phrases after ``incoming`` (a row a key) is saved, and the keys refused.

    Saving replaces all phrases of a dictionary and keeps the time it was created; where it must be new, one that is
    there already is refused. The search text is key, name and description in lower case.
    """
    there = base.select("key", F.col("created_ms").alias("__was"))
    marked = incoming.join(there, "key", "left")
    refused = marked.where(F.col("__was").isNotNull()).select("key") if must_be_new else marked.where("false").select("key")
    taken = marked.where(F.col("__was").isNull()) if must_be_new else marked
    search = F.lower(F.concat_ws(" ", "key", "name", "description"))
    rows = taken.select("key", "name", "description", "score", search.alias("search"), F.coalesce("__was", F.lit(now_ms)).alias("created_ms"), F.lit(now_ms).cast("long").alias("updated_ms"))
    keys = taken.select(F.col("key").alias("dict_key"))
    lines = new_phrases.join(keys, "dict_key", "left_semi").select("dict_key", "ord", "phrase", F.lower("phrase").alias("phrase_lc"))
    return (
        base.join(taken.select("key"), "key", "left_anti").unionByName(rows),
        phrases.join(keys, "dict_key", "left_anti").unionByName(lines),
        refused,
    )


def listed(dicts: DataFrame, limit: int = LISTED) -> DataFrame:
    """The dictionaries changed last, at most 200."""
    return dicts.orderBy(F.desc("updated_ms"), "key").limit(limit if 1 <= limit <= LISTED else LISTED)


def resolve(requests: DataFrame, dicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionaries that apply to requests (id, standing, asked, score): (id, place, key), and (id, score, missing, error).

    Standing keys come before those asked for, each key once. A standing key that is gone is told in ``missing``; one
    asked for that isn't there is the request's error, and nothing applies. A request without a score takes the first
    above 0 of those asked for, then of the standing ones.
    """
    part = lambda c, own: requests.select("id", "score", F.lit(own).alias("own"), F.posexplode(c).alias("k", "key"))
    keys = part("standing", 0).unionByName(part("asked", 1)).where("key <> ''")
    first = keys.groupBy("id", "key").agg(F.min(F.struct("own", "k")).alias("at"), F.any_value("score").alias("score"))
    found = first.join(dicts.select("key", F.col("score").alias("of")), "key", "left")
    own, gone = F.col("at.own") == 1, F.col("of").isNull()
    told = found.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(gone & ~own, F.struct("at", "key")))), lambda x: x["key"]), ",").alias("missing"),
        F.min(F.when(gone & own, F.struct("at", "key")))["key"].alias("error"),
        F.min(F.when(F.col("of") > 0, F.struct((1 - F.col("at.own")).alias("o"), F.col("at.k").alias("k"), "of")))["of"].alias("best"),
        F.any_value("score").alias("score"),
    )
    told = told.select("id", F.when(F.col("score") != 0, F.col("score")).otherwise(F.coalesce("best", F.lit(0))).alias("score"), "missing", "error")
    place = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    used = found.where(~gone).join(told.where("error IS NULL").select("id"), "id", "left_semi")
    return used.select("id", place.alias("place"), "key"), told


def counts(keys: DataFrame, phrases: DataFrame) -> DataFrame:
    """(dict_key, phrases): the number of phrases of each dictionary, 0 for empty ones."""
    return keys.join(phrases.groupBy("dict_key").agg(F.count("*").alias("phrases")), "dict_key", "left").select("dict_key", F.coalesce("phrases", F.lit(0)).alias("phrases"))


def top_matches(phrases: DataFrame, q: str, k: int = 5) -> DataFrame:
    return first_k(phrases.where(holds(F.col("phrase"), q)), ["dict_key"], [F.col("ord")], k)


def merge_dictionaries(phrases: DataFrame, order: Column) -> DataFrame:
    """Each phrase once, at its first place: by dictionary in the order given, then by place in it."""
    place = F.min(F.struct(order.alias("dict_ord"), F.col("ord"))).alias("at")
    return phrases.groupBy("phrase").agg(place).select("phrase", "at.dict_ord", "at.ord")


def search(keys: DataFrame, phrases: DataFrame, q: str) -> DataFrame:
    """Dictionaries (dict_key, search) with the text asked for in their search text or in any phrase."""
    hit = phrases.where(holds(F.col("phrase"), q)).select("dict_key").distinct().withColumn("__hit", F.lit(True))
    return keys.join(hit, "dict_key", "left").where(holds(F.col("search"), q) | F.coalesce("__hit", F.lit(False))).drop("__hit")


def matching(keys: DataFrame, phrases: DataFrame, q: str) -> DataFrame:
    """Dictionaries with a phrase that has the text asked for in it."""
    return keys.join(phrases.where(holds(F.col("phrase"), q)), "dict_key", "left_semi")


def export_text(dicts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(dict_key, part, ord, line): key, name (if another) and description as comments, then the phrases, a line each.

    Lines come as rows, so that a dictionary of any size can be written sorted by (part, ord).
    """
    notes = F.filter(F.transform(F.split(F.coalesce("description", F.lit("")), "\n"), F.trim), lambda x: x != "")
    names = F.when((F.col("name") != "") & (F.col("name") != F.col("key")), F.array("key", "name")).otherwise(F.array("key"))
    head = dicts.select(F.col("key").alias("dict_key"), F.posexplode(F.concat(names, notes)).alias("ord", "line"))
    head = head.select("dict_key", F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("# "), "line").alias("line"))
    return head.unionByName(phrases.select("dict_key", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.col("phrase").alias("line")))


def export_json(dicts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, json): a dictionary as an object with its phrases in order; its size is limited as phrases are."""
    own = phrases.groupBy(F.col("dict_key").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "phrase"))), lambda p: p["phrase"]).alias("phrases"))
    return dicts.join(own, "key").select("key", F.to_json(F.struct("key", "name", "description", "score", "phrases")).alias("json"))
