"""Runs of words that repeat with a period, from a suffix automaton whose links a link-cut forest gives access to."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.llm.common import WORD, batches, by_document, give_back, read, record, utf8, words

#: Bytes of texts taken at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 22
#: A run has this many words at least, and holds its period this many times.
LEAST, POWER = 6, 4


class LastEnds:
    """The suffix automaton of the words so far; its suffix links are a forest of preferred paths, each with the last place where its words ended.

    State 1 stands for nothing, 0 for no state. A state's transitions are one pair, or a dictionary from the second
    on. Paths are splay trees in order of length; the root of each has its path's place, and its ``parent`` is
    the state above the path.
    """

    def __init__(self, n: int):
        size = 2 * n + 2
        self.length, self.link, self.word, self.target, self.left, self.right, self.parent, self.ended = (array("i", bytes(4 * size)) for _ in range(8))
        self.more: dict[int, dict[int, int]] = {}
        self.states, self.last, self.n = 1, 1, 0
        self.word[1] = -1

    def _splay(self, x: int) -> None:
        """Make x the root of its path's tree; the path's place goes with the root."""
        left, right, parent = self.left, self.right, self.parent
        p = parent[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while True:
            g = parent[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[p] == x) == (left[g] == p):
                self._turn(p, g)
                self._turn(x, p)
            elif inner:
                self._turn(x, p)
                self._turn(x, g)
            else:
                self._turn(x, p)
            p = parent[x]
            if not p or (left[p] != x and right[p] != x):
                return

    def _turn(self, x: int, p: int) -> None:
        """Lift x above its parent p."""
        left, right, parent = self.left, self.right, self.parent
        g = parent[p]
        if left[p] == x:
            child = right[x]
            left[p], right[x] = child, p
        else:
            child = left[x]
            right[p], left[x] = child, p
        if child:
            parent[child] = p
        parent[p], parent[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.ended[x] = self.ended[p]

    def append(self, c: int) -> list[tuple[int, int]]:
        """Append a word: the (last end, length) of each path segment of the new text's suffixes, which now end here."""
        length, link, word, target, more = self.length, self.link, self.word, self.target, self.more
        self.n += 1
        self.states += 1
        new, p = self.states, self.last
        length[new], word[new], self.last = length[p] + 1, -1, new
        while p:
            q = target[p] if word[p] == c else more[p].get(c, 0) if p in more else 0
            if q:
                break
            self._go(p, c, new)
            p = link[p]
        if not p:
            above = 1
        elif length[p] + 1 == length[q]:
            above = q
        else:
            above = self._split(p, c, q)
        link[new] = self.parent[new] = above
        return self._access(new)

    def _go(self, p: int, c: int, to: int) -> None:
        if p in self.more:
            self.more[p][c] = to
        elif self.word[p] in (-1, c):
            self.word[p], self.target[p] = c, to
        else:
            self.more[p] = {self.word[p]: self.target[p], c: to}
            self.word[p] = -2

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the shorter words of q, put above it on its path: they ended last where q's did."""
        link, word, target, more = self.link, self.word, self.target, self.more
        self.states += 1
        made = self.states
        self.length[made], link[made] = self.length[p] + 1, link[q]
        word[made], target[made] = word[q], target[q]
        if q in more:
            more[made] = dict(more[q])
        while p and (target[p] if word[p] == c else more[p].get(c, 0) if p in more else 0) == q:
            self._go(p, c, made)
            p = link[p]
        link[q] = made
        self._splay(q)
        above = self.left[q]
        self.left[made], self.left[q], self.parent[made] = above, made, q
        if above:
            self.parent[above] = made
        return made

    def _access(self, new: int) -> list[tuple[int, int]]:
        left_off, found, u = 0, [], new
        ended, right, parent, length = self.ended, self.right, self.parent, self.length
        while u:
            self._splay(u)
            if ended[u]:
                found.append((ended[u], length[u]))
            if right[u]:
                ended[right[u]] = ended[u]
            right[u] = left_off
            left_off, u = u, parent[u]
        self._splay(new)
        ended[new] = self.n
        return found


def runs_of(codes: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs among coded words.

    When a suffix of ``length`` words that ended last at ``e`` ends again at ``i``, the text has period i - e over
    length + i - e words up to here, and no shorter one, if that is two periods or more. It can't be longer to the left, as the segment's
    longest suffix is taken; it is a run if the next word breaks the period, else it is found again one word on.
    """
    tree, out, n = LastEnds(len(codes)), [], len(codes)
    for i, c in enumerate(codes, 1):
        for e, length in tree.append(c):
            q = i - e
            if (power - 1) * q <= length and length + q >= least and (i == n or codes[i] != codes[i - q]):
                out.append((i - length - q, length + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(codes: np.ndarray, doc: np.ndarray, least: int = LEAST, power: int = POWER) -> Iterator[tuple[int, int]]:
    """Parts [a, b) of the texts that hold all their runs; the rest needn't be appended.

    A run of ``least`` words or more that holds its period ``power`` times has least - 2 windows of three words or
    more, each of them in the run power - 1 times at least. Windows are counted by hash, so that some may seem more
    frequent than they are and none less.
    """
    n = len(codes) - 2
    if n < 1:
        return
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = mixed[:n] * np.uint64(0xBF58476D1CE4E5B9) + mixed[1 : n + 1] * np.uint64(0x94D049BB133111EB) + mixed[2:] + doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h *= np.uint64(0x2545F4914F6CDD1D)
    bits = int(n).bit_length() + 2
    cell = (h >> np.uint64(64 - bits)).astype(np.int64)
    often = np.minimum(np.bincount(cell, minlength=1 << bits), 255).astype(np.uint8)[cell] >= power - 1
    often &= doc[:n] == doc[2:]
    change = np.flatnonzero(np.diff(np.concatenate(([0], often.view(np.int8), [0])))).reshape(-1, 2)
    for a, b in change.tolist():
        cuts = (a + 1 + np.flatnonzero(doc[a + 1 : b] != doc[a : b - 1])).tolist()
        for x, y in zip([a, *cuts], [*cuts, b], strict=True):
            if y - x >= least - 2:
                yield x, y + 2


def _find(schema: pa.Schema, least: int, power: int):
    kind = schema.field("runs").type.value_type

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, CHUNK_BYTES):
            raw, at = utf8(batch.column("text"))
            doc, listed = words(raw, at)
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            codes = listed.dictionary_encode().indices.to_numpy()
            found, kept = [], np.ones(len(doc), bool)
            for a, b in stretches(codes, doc, least, power):
                _, local = np.unique(codes[a:b], return_inverse=True)
                for start, length, q in runs_of(local.tolist(), least, power):
                    kept[a + start + q : a + start + length] = False
                    found.append((doc[a], a + start - first[doc[a]], length, q))
            table = np.array(found, np.int64).reshape(-1, 4)
            table = table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))]
            structs = pa.StructArray.from_arrays([pa.array(table[:, k], f.type) for k, f in zip((1, 2, 3), kind, strict=True)], fields=list(kind))
            lists = pa.ListArray.from_arrays(np.searchsorted(table[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32), structs)
            ends = np.concatenate(([0], np.cumsum(kept)))[first]
            held = pa.ListArray.from_arrays(ends.astype(np.int32), listed.filter(pa.array(kept)).cast(pa.large_string()))
            yield record(schema, doc_id=batch.column("doc_id"), n_words=np.diff(first), runs=lists, collapsed=pc.binary_join(held, pa.scalar(" ", pa.large_string())).cast(schema.field("collapsed").type))
        give_back()

    return run


def collapse_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each text's maximal runs (start, length, period), in words, and the text with one period of each left.

    Words are parted by ASCII white space and numbered from 0; runs have ``least`` words or more and hold their
    smallest period ``power`` times or more (2 at least); they come by start, then period. ``collapsed`` has the words that no run covers
    after its first period, joined by one space. Null and empty texts have no words and no runs; null ids, repeated
    rows and ids of any type are kept, other columns dropped; an empty table gives no rows. A text is one row and is taken whole: its
    automaton takes about 70 bytes a word of the stretches that may hold runs.
    """
    if power < 2 or least < 3:
        raise ValueError("a run holds its period twice and has three words at least")
    fields, schema = by_document(docs, "n_words long, runs array<struct<start long, length long, period long>>, collapsed string")
    return docs.select("doc_id", "text").mapInArrow(_find(schema, least, power), fields)


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text), but with a loop from word g % n on where the id's CRC-32 ends in 0; g is the CRC-32 without that digit."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    looped = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    n, g = F.size("found"), F.col("g")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), looped.alias("found")).withColumns({"a": g % F.nullif(n, F.lit(0)), "k": F.lit(3) + g % 8})
    rows = rows.withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / F.col("k")))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    return rows.select("doc_id", F.when(n > 0, F.array_join(F.transform("found", lambda _, i: F.get("found", at(i))), " ")).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents with the planted loops, and digests of runs and collapsed texts; see ``collapse_runs`` for odd rows."""
    docs = read(spark, sf_dir, "documents")
    found = collapse_runs(with_loops(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    top = found.withColumn("best", best)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Windows of 2^j words are named by where they first occur, from the names of their halves; those that occur once
#: can't lie in a run and go. With period q <= 2^j < 2q, a run's windows occur again q words on and no sooner.
OP13_SQL = r"""
WITH RECURSIVE ids AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws,
  list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INTEGER), 1))::BIGINT) AS bytes FROM documents),
hashed AS (SELECT id, doc_id, ws, len(ws) AS n, CASE WHEN doc_id IS NOT NULL THEN
  xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) END AS h FROM ids),
placed AS (SELECT *, h % 10 = 0 AND n > 0 AS loops, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM hashed),
tok AS (SELECT id, CAST(unnest(range(n)) AS BIGINT) AS i, unnest(CASE WHEN loops THEN list_transform(range(n), lambda k: ws[1 + CAST(CASE WHEN k < a THEN k ELSE a + (k - a) % p END AS BIGINT)]) ELSE ws END) AS w FROM placed),
win AS (SELECT id, i, first AS name, 1::BIGINT AS k, 0 AS j FROM (SELECT id, i, min(i) OVER (PARTITION BY id, w) AS first, count(*) OVER (PARTITION BY id, w) AS c FROM tok) WHERE c > 1
  UNION ALL
  SELECT id, i, first, 2 * k, j + 1 FROM (SELECT x.id, x.i, x.k, x.j, min(x.i) OVER s AS first, count(*) OVER s AS c FROM win x JOIN win y ON y.id = x.id AND y.i = x.i + x.k
    WINDOW s AS (PARTITION BY x.id, x.name, y.name)) WHERE c > 1),
again AS (SELECT id, i, k, lead(i) OVER (PARTITION BY id, k, name ORDER BY i) - i AS q FROM win),
paced AS (SELECT id, i, k, q, i - row_number() OVER (PARTITION BY id, k, q ORDER BY i) AS island FROM again WHERE q <= k AND k < 2 * q),
runs AS (SELECT id, min(i) AS start, max(i) - min(i) + k + q AS length, q AS period FROM paced GROUP BY id, k, q, island HAVING max(i) - min(i) + k + q >= greatest(6, 4 * q)),
tops AS (SELECT id, count(*) AS n_runs, max({'length': length, 'start': -start, 'period': -period}) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY id),
gone AS (SELECT DISTINCT t.id, t.i FROM tok t JOIN runs r ON r.id = t.id AND t.i >= r.start + r.period AND t.i < r.start + r.length),
held AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM tok ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.start AS start, best.length AS length, -best.period AS period, 1000 * best.length // -best.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM ids LEFT JOIN tops USING (id) LEFT JOIN held USING (id)
"""
