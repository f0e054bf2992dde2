"""Secret scans over a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

import re
from re import _constants as node_kind
from re import _parser as regex_tree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.llm.common import read, settle

#: Kind, pattern, the group whose length counts, its least length. The first three are the base.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
    ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1),
    ("github", r"(gh[pousr]_[A-Za-z0-9]+)", 1, 40),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]+)", 1, 15),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 40),
]
BASE = ["assign", "access", "hex"]
#: Candidates (an id and a few rule names each) that are sent to every task; more are shuffled.
SENT = 200_000
#: Places of a block of running sums.
_RUN = 64
_WIDEST = 64  # exact strings kept while deriving; more than these count as unknown


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The Boolean trigram query of a regex: any of these sets must be wholly in the lower-cased text.

    An empty list means that the regex has no mandatory trigrams and its texts must all be scanned.
    """
    clauses, open_ends = _walk(list(regex_tree.parse(pattern)), {""})
    clauses = _both(clauses, _required(open_ends))
    return sorted(clauses, key=sorted) if frozenset() not in clauses else []


def _required(strings: set[str]) -> set[frozenset[str]]:
    """What a text must hold if it holds one of the strings."""
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _least(clauses: set[frozenset[str]]) -> set[frozenset[str]]:
    return {c for c in clauses if not any(d < c for d in clauses)}


def _both(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    return _least({x | y for x in a for y in b})


def _walk(nodes: list, strings: set[str]) -> tuple[set[frozenset[str]], set[str]]:
    """Clauses that hold so far, and the strings one of which the match has just passed."""
    clauses = {frozenset()}
    for kind, value in nodes:
        if kind is node_kind.LITERAL:
            more = {chr(value).lower()}
        elif kind is node_kind.IN and all(k is node_kind.LITERAL for k, _ in value) and len(value) <= 8:
            more = {chr(v).lower() for _, v in value}
        elif kind is node_kind.SUBPATTERN:
            inner, strings = _walk(list(value[-1]), strings)
            clauses = _both(clauses, inner)
            continue
        elif kind is node_kind.BRANCH:
            ways = [_walk(list(way), strings) for way in value[1]]
            clauses = _both(clauses, _least(set().union(*(c for c, _ in ways))))
            strings = set().union(*(s for _, s in ways))
            continue
        elif kind in (node_kind.MAX_REPEAT, node_kind.MIN_REPEAT) and value[:2] == (0, 1):
            inner, longer = _walk(list(value[2]), strings)
            clauses, strings = (clauses, strings | longer) if inner == {frozenset()} else (_both(clauses, _required(strings)), {""})
            continue
        elif kind in (node_kind.MAX_REPEAT, node_kind.MIN_REPEAT) and value[0] == value[1] and value[0] <= 8:
            inner, strings = _walk(list(value[2]) * value[0], strings)
            clauses = _both(clauses, inner)
            continue
        else:
            more = set()
        joined = {s + c for s in strings for c in more}
        if joined and len(joined) <= _WIDEST:
            strings = joined
        else:
            clauses, strings = _both(clauses, _required(strings)), {""}
    return clauses, strings


def trigram_postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The inverted index as rows (trigram, doc_id), for the trigrams that some query asks for."""
    low = F.lower("text")
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("__low"), F.lit(t)), F.lit(t)) for t in vocabulary)))
    return docs.select("doc_id", low.alias("__low")).select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: list = RULES) -> DataFrame:
    """(doc_id, rules): the rules of which some clause has all its trigrams in the document's postings."""
    parts = [(kind, k, t, 1 << i, (1 << len(c)) - 1) for kind, p, *_ in rules for k, c in enumerate(trigram_query(p)) for i, t in enumerate(sorted(c))]
    clauses = docs.sparkSession.createDataFrame(parts, "kind string, clause int, trigram string, bit long, whole long")
    return (
        trigram_postings(docs, sorted({p[2] for p in parts}))
        .join(F.broadcast(clauses), "trigram")  # a row for each trigram of the fixed rules
        .groupBy("doc_id", "kind", "clause", "whole")
        .agg(F.bit_or("bit").alias("found"))
        .where("found = whole")
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("__rules"))
    )


def _let(value: Column, use) -> Column:
    """``use(x)`` with ``value`` worked out once and not at each place that names it."""
    return F.transform(F.array(value), use)[0]


def _running(steps: Column, join) -> Column:
    """What an array of numbers comes to before each place (0 before the first), joined by + or the like.

    In blocks, so that the work isn't the square of the array's length.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), join)
    upto = lambda xs, n: F.when(n > 0, F.slice(xs, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def sums(blocks):
        ahead = F.transform(blocks, total)
        bases = _let(ahead, lambda t: F.transform(t, lambda _, k: total(upto(t, k))))
        return _let(bases, lambda t: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda _, j: join(t[k], total(upto(b, j)))))))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _RUN).cast("int")), lambda k: F.slice(xs, k * _RUN + 1, F.lit(_RUN)))
    return _let(steps, lambda xs: F.when(F.size(xs) > 0, _let(cut(xs), sums)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, order, end, kind) of a rule's leftmost matches that don't overlap, in code points.

    split() gives what lies between the matches, so running lengths of both give positions.
    """
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.zip_with(F.zip_with(between, whole, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))), counted, lambda x, c: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.length(c).alias("counted")))

    def rows(found):
        own = F.filter(found, lambda x: x["hit"].isNotNull())
        starts = _running(F.transform(own, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b)
        placed = lambda at: F.transform(own, lambda x, k: F.struct((at[k] + x["gap"]).alias("start"), F.lit(order).alias("ord"), (at[k] + x["gap"] + x["hit"]).alias("end"), F.lit(kind).alias("kind"), x["counted"].alias("counted")))
        kept = F.filter(_let(starts, placed), lambda x: x["counted"] >= least)
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind")))

    return _let(lengths, rows)


def find_secrets(docs: DataFrame, rules: list = RULES) -> DataFrame:
    """(row, spans) for each row of ``docs``: all its columns, and an array of (start, ord, end, kind) by start, then rule.

    A rule with mandatory trigrams is verified only where the index has them; the others scan every text. The
    candidates go back to the texts by id, sent to all tasks where they are at most ``SENT`` and shuffled otherwise.
    Null texts count as empty and have no spans. Texts without an id are verified for every rule, as the index can't
    name them; rows that share an id share their candidates, which verification decides row by row. Ids may be of
    any type; no column name clashes; empty tables give no rows.
    """
    asked = settle(candidates(docs.select("doc_id", "text"), rules).withColumnRenamed("doc_id", "id"))
    asked = F.broadcast(asked) if asked.limit(SENT + 1).count() <= SENT else asked
    held = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("body"), F.struct(*docs.columns).alias("row"))
    text, named = F.col("body"), F.col("key").isNotNull()
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        run = pattern[:-2] + "{%d,})" % least if pattern.startswith("([") else pattern  # runs of one class: the short ones needn't be met
        hit = text.rlike(run)
        hit = F.when(named, F.coalesce(F.array_contains("__rules", kind), F.lit(False))).otherwise(True) & hit if trigram_query(pattern) else hit
        found.append(F.when(hit, _spans(text, order, kind, run, group, least)).otherwise(none))
    return held.join(asked, F.col("key") == F.col("id"), "left").select("row", F.array_sort(F.concat(*found)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; see ``find_secrets`` for nulls, empty texts and repeated rows."""
    found = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return found.select("row.doc_id", *map(count, BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans become one mark. Null stays null.

    The other columns stay as they are; see ``find_secrets`` for the edges.
    """
    text = F.col("row.text")

    def rest(spans):
        reach = _running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        gaps = lambda at: F.transform(spans, lambda x, k: F.when(x["start"] >= at[k], F.concat(F.substr(text, at[k] + 1, x["start"] - at[k]), F.lit(mark))))
        tail = F.substr(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1)
        return F.concat(F.array_join(_let(reach, gaps), ""), tail)

    clean = F.when(F.size("spans") > 0, _let(F.col("spans"), rest)).otherwise(text)
    made = F.struct(*((clean if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
    return find_secrets(docs).select(made.alias("row")).select("row.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the secrets in their texts struck out; see ``find_secrets`` for the edges."""
    return redact(docs)


def _oracle() -> str:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        parts.append(f"""
SELECT id, {order} AS ord, '{kind}' AS kind, gap_end + coalesce(sum(hit) OVER w, 0) AS s, gap_end + coalesce(sum(hit) OVER w, 0) + hit AS e, counted >= {least} AS ok
FROM (SELECT id, i, length(m) AS hit, length(g) AS counted, sum(length(b)) OVER (PARTITION BY id ORDER BY i) AS gap_end
  FROM (SELECT id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(bs[1:len(ms)]) AS b
    FROM (SELECT id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS gs, string_split_regex(text, '{p}') AS bs
      FROM docs WHERE regexp_matches(text, '{p}')))) WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
spans AS (SELECT id, ord, kind, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS t, s, e FROM ({" UNION ALL ".join(parts)}) WHERE ok),
joined AS (SELECT id, count(*) FILTER (ord = 0) AS a, count(*) FILTER (ord = 1) AS k, count(*) FILTER (ord = 2) AS h,
  string_agg(t, ',' ORDER BY s, ord, e) FILTER (ord < 3) AS base, string_agg(t, ',' ORDER BY s, ord, e) AS spans FROM spans GROUP BY id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (id)
"""


OP5_SQL = _oracle()
