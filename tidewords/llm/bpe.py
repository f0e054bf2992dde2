"""Byte-level BPE: pairs are contracted by a recursive DuckDB query inside each partition."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewords.llm.common import batches, by_document, give_back, read, record, slices, utf8

#: Bytes of texts taken at once; a longer text is taken in pieces of about this size.
CHUNK_BYTES = 1 << 20
#: Rows of one query over all its steps (a word of n bytes makes at most n * n), words kept.
QUERY_ROWS, KEPT_WORDS = 1 << 19, 150_000
#: Bytes of the windows that a longer word is contracted in, and how far around a seam is looked for a place to cut.
WINDOW, AROUND = 96, 32
#: Tokens of one decoding query; a longer piece takes several.
DECODED = 1 << 18
OTHER, LETTER, NUMBER, SPACE = range(4)
# Fixed values of the splitting pattern: letters that may follow an apostrophe as one token with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_CONTRACT = """
WITH RECURSIVE steps AS (
  SELECT word, pos, id, true AS more FROM start
  UNION ALL
  SELECT s.word, s.pos - coalesce((s.pos > b.best & 4294967295)::INTEGER, 0), CASE WHEN s.pos = b.best & 4294967295 THEN (b.best >> 32)::INTEGER ELSE s.id END, b.best IS NOT NULL
  FROM steps s LEFT JOIN (
    SELECT p.word, min(m.merged::BIGINT * 4294967296 + p.pos) AS best
    FROM steps p JOIN steps q ON q.word::BIGINT * 4294967296 + q.pos = p.word::BIGINT * 4294967296 + p.pos + 1 JOIN merges m ON m.pair = p.id::BIGINT * 4294967296 + q.id
    WHERE p.more GROUP BY p.word) b USING (word)
  WHERE s.more AND (b.best IS NULL OR s.pos <> (b.best & 4294967295) + 1))
SELECT word, pos, id FROM steps WHERE NOT more
"""
#: The same, but all places of a word's minimum-rank pair in a step, the first of those that overlap.
_CONTRACT_ALL = """
WITH RECURSIVE steps AS (
  SELECT word, pos, id, true AS more FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN hit THEN best ELSE id END, best IS NOT NULL
  FROM (SELECT *, coalesce(lag(hit) OVER (PARTITION BY word ORDER BY pos), false) AS gone
    FROM (SELECT *, least AND row_number() OVER (PARTITION BY word, least, run ORDER BY pos) & 1 = 1 AS hit
      FROM (SELECT *, n - row_number() OVER (PARTITION BY word, least ORDER BY pos) AS run
        FROM (SELECT *, merged IS NOT NULL AND merged = best AS least, row_number() OVER (PARTITION BY word ORDER BY pos) AS n
          FROM (SELECT s.word, s.pos, s.id, m.merged, min(m.merged) OVER (PARTITION BY s.word) AS best
            FROM (SELECT word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS after FROM steps WHERE more) s
            LEFT JOIN merges m ON m.pair = s.id::BIGINT * 4294967296 + s.after)))))
  WHERE NOT gone)
SELECT word, pos, id FROM steps WHERE NOT more
"""
_DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY place) AS hex FROM tokens JOIN vocabulary USING (id) GROUP BY doc
"""


def load(path: str) -> bytes:
    """A rank file's bytes: lines of a base64 token and its rank. Read on the driver and sent with the task."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """A partition's tables for one rank file, with the words it has seen; a context that frees them."""

    def __init__(self, raw: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.tokens = {r: t for t, r in self.ranks.items()}
        if len(self.tokens) < len(self.ranks) or not all(0 <= r < 1 << 31 for r in self.tokens):
            raise ValueError("ranks must differ and be whole numbers below 2^31")
        self.known = {t: np.uint32(r).tobytes() for t, r in self.ranks.items()}
        self.room = len(self.known) + KEPT_WORDS
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.sql = duckdb.connect(config={"threads": "1", "memory_limit": "160MB", "temp_directory": ""})
        halves = ((self.ranks.get(t[:i]), self.ranks.get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t)))
        pairs = np.fromiter((x for h in halves if None not in h for x in h), np.int64).reshape(-1, 3)
        self._table("merges", {"pair": pairs[:, 0] << 32 | pairs[:, 1], "merged": pairs[:, 2].astype(np.int32)})
        self._table("vocabulary", {"id": np.fromiter(self.tokens, np.int32), "piece": [t.hex() for t in self.tokens.values()]})
        self.joined = np.zeros((256, 256), bool)  # pairs of bytes that lie side by side in some token
        for t in self.tokens.values():
            self.joined[np.frombuffer(t[:-1], np.uint8), np.frombuffer(t[1:], np.uint8)] = True
        self.proper: bool | None = None
        self.kinds = np.zeros(0x110000, np.uint8)
        for low in range(0, 0x110000, 0x10000):
            plane = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(low, low + 0x10000))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
                for m in regex.finditer(pattern, plane):
                    self.kinds[low + m.start() : low + m.end()] = kind

    def __enter__(self) -> "Codec":
        return self

    def __exit__(self, *_) -> None:
        self.sql.close()
        self.__dict__.clear()
        give_back()

    def _table(self, name: str, columns: dict) -> None:
        made = pa.table(columns)  # noqa: F841  DuckDB reads it by name
        self.sql.execute(f"CREATE TABLE {name} AS SELECT * FROM made")

    def _ask(self, query: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.sql.register(name, table)
        try:
            return self.sql.sql(query).to_arrow_table()
        finally:
            for name in tables:
                self.sql.unregister(name)

    def word_starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where the splitting pattern's matches start, over texts that lie end to end."""
        code = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        byte_at = np.zeros(n + 1, np.int64)
        np.cumsum(1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000), out=byte_at[1:])
        first = np.zeros(n + 4, bool)  # true beyond the end too
        first[np.searchsorted(byte_at, offsets[:-1])] = True
        first[n:] = True
        kind = np.concatenate((self.kinds[code], np.zeros(4, np.uint8)))
        starts = first.copy()
        starts[1:n] |= kind[1:n] != kind[: n - 1]
        # White space before a word gives up its last character: a blank joins the word, anything else stands alone.
        last = np.flatnonzero((kind[:n] == SPACE) & (kind[1 : n + 1] != SPACE) & ~first[1 : n + 1])
        starts[last] = True
        starts[last[code[last] == 32] + 1] = False
        mark = np.flatnonzero((code == 39) & starts[:n] & (kind[1 : n + 1] == LETTER) & ~first[1 : n + 1])
        ahead = np.concatenate((code, np.zeros(4, np.uint32)))
        for tail in CONTRACTIONS:
            k = len(tail)
            hit = mark[np.all([(ahead[mark + 1 + i] == ord(c)) & ~first[mark + 1 + i] for i, c in enumerate(tail)], axis=0)] if len(mark) else mark
            starts[hit + 1] = False
            starts[hit + 1 + k] = True
        return byte_at[:n][starts[:n]]

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of words by contraction, queries of words of like length, so that a query's steps end together."""
        out: list[bytes] = [b""] * len(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        for a, b in slices(np.concatenate(([0], np.cumsum(lens[order] ** 2))), QUERY_ROWS):
            some, n = [words[i] for i in order[a:b].tolist()], lens[order[a:b]]
            start = {"word": np.repeat(np.arange(len(some), dtype=np.int32), n), "id": self.byte_ids[np.frombuffer(b"".join(some), np.uint8)]}
            start["pos"] = (np.arange(len(start["id"])) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            got = self._ask(_CONTRACT_ALL if self.proper and n[-1] > WINDOW + AROUND else _CONTRACT, start=pa.table(start))
            word, pos, ids = (got[c].to_numpy() for c in ("word", "pos", "id"))
            flat = ids[np.lexsort((pos, word))].astype("<u4").tobytes()
            ends = [0, *(4 * np.cumsum(np.bincount(word, minlength=len(some)))).tolist()]
            for i, x, y in zip(order[a:b].tolist(), ends, ends[1:], strict=False):
                out[i] = flat[x:y]
        return out

    def _ids(self, words: list[bytes], windows: bool = True) -> list[bytes]:
        """Ids of words, those that are known or repeated only once; long ones in windows, if so asked."""
        missing = list(dict.fromkeys(w for w in words if w not in self.known))
        whole = [w for w in missing if len(w) <= WINDOW + AROUND or not windows]
        learnt = dict(zip(whole, self._contract(whole), strict=True))
        learnt.update((w, self._long(w)) for w in missing if w not in learnt)
        for w in missing[: max(0, self.room - len(self.known))]:
            if len(w) <= WINDOW:
                self.known[w] = learnt[w]
        return [learnt[w] if w in learnt else self.known[w] for w in words]

    def _long(self, word: bytes) -> bytes:
        """Ids of a long word, put together from windows of it.

        No merge goes over a place whose two bytes lie side by side in no token. Elsewhere a seam is right if the
        tokens on both its sides, joined and encoded again, come out as they were: where every token of a
        vocabulary encodes to itself, a row of tokens of which all neighbours pass that test is the encoding of
        its bytes. A seam that fails goes, and its two windows become one. In such a vocabulary a merge never makes
        a pair of lower rank than its own, so all places of the least pair of a joined window go in one step.
        """
        raw = np.frombuffer(word, np.uint8)
        apart = np.flatnonzero(~self.joined[raw[:-1], raw[1:]]) + 1
        sure, cuts = set(apart.tolist()), [0]
        middles = list(range(WINDOW, len(word) - AROUND, WINDOW)) if self._is_proper() else []
        near = [int(apart[i]) if i < len(apart) and apart[i] < m + AROUND else 0 for m, i in zip(middles, np.searchsorted(apart, np.array(middles, np.int64) - AROUND), strict=True)]
        looks = [m for m, c in zip(middles, near, strict=True) if not c]
        for m, ids in zip(looks, self._ids([word[m - AROUND : m + AROUND] for m in looks]), strict=True):
            ends = np.cumsum([len(self.tokens[i]) for i in np.frombuffer(ids, "<u4").tolist()])
            near.append(m - AROUND + int(ends[np.argmin(np.abs(ends - AROUND))]))
        cuts = sorted({0, len(word), *(c for c in near if 0 < c < len(word)), *(sure if not middles else ())})
        while True:
            parts = [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            coded = self._ids(parts, windows=False)
            seams = [k for k in range(1, len(parts)) if cuts[k] not in sure]
            sides = [coded[k - 1][-4:] + coded[k][:4] for k in seams]
            both = self._ids([b"".join(self.tokens[i] for i in np.frombuffer(x, "<u4").tolist()) for x in sides], windows=False)
            wrong = {k for k, x, y in zip(seams, sides, both, strict=True) if x != y}
            if not wrong:
                return b"".join(coded)
            cuts = [c for k, c in enumerate(cuts) if k not in wrong]

    def _is_proper(self) -> bool:
        """Does every token of the vocabulary come out of the contraction of its own bytes?"""
        if self.proper is None:
            tokens = list(self.ranks)
            self.proper = self._contract(tokens) == [np.uint32(self.ranks[t]).tobytes() for t in tokens]
        return self.proper

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end, and offsets into them by text."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self.word_starts(raw, offsets)
        places = np.append(starts, len(raw))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        index, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
        ids = self._ids(distinct)
        flat = np.frombuffer(b"".join(ids), "<u4")
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        per_word = counts[index]
        ends = np.concatenate(([0], np.cumsum(per_word)))
        shift = (np.cumsum(counts) - counts)[index] - ends[:-1]
        out = flat[np.arange(ends[-1]) + np.repeat(shift, per_word)]
        return out, ends[np.searchsorted(starts, offsets)]

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The texts as they are, or a single long text in pieces that the splitting pattern parts anyway.

        A match never goes on from a letter or a number to a character of another kind, and none looks back.
        """
        if len(offsets) != 2 or len(raw) <= CHUNK_BYTES:
            yield raw, offsets
            return
        start, reach = 0, CHUNK_BYTES
        while start < len(raw):
            stop = min(start + reach, len(raw))
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                stop += 1
            if stop < len(raw):
                tail = max(start, stop - 4096 if reach == CHUNK_BYTES else start)
                while raw[tail] & 0xC0 == 0x80:
                    tail += 1
                code = np.frombuffer(raw[tail:stop].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
                kind = self.kinds[code]
                at = np.flatnonzero(((kind[:-1] == LETTER) | (kind[:-1] == NUMBER)) & (kind[1:] != kind[:-1]))
                if not len(at):
                    reach += CHUNK_BYTES
                    continue
                stop = tail + int(1 + at[-1] + (code[: at[-1] + 1] >= 0x80).sum() + (code[: at[-1] + 1] >= 0x800).sum() + (code[: at[-1] + 1] >= 0x10000).sum())
            yield raw[start:stop], np.array([0, stop - start])
            start, reach = stop, CHUNK_BYTES

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(text, bytes) of the texts' ids, pieces joined in order of position; a long text comes in several blocks in order."""
        for a in range(0, len(ids), DECODED):
            at = np.arange(a, min(a + DECODED, len(ids)))
            doc = (np.searchsorted(offsets, at, "right") - 1).astype(np.int32)
            got = self._ask(_DECODE, tokens=pa.table({"doc": doc, "place": at, "id": ids[a : a + DECODED].astype(np.int32)}))
            for d, h in zip(got["doc"].to_pylist(), got["hex"].to_pylist(), strict=True):
                yield d, bytes.fromhex(h)


def _coded(codec: Codec, batch: pa.RecordBatch, seen) -> tuple[np.ndarray, list[str], list[str]]:
    """Token counts and digests of ids and decoded bytes of a batch's texts; ``seen`` gets the ids of each piece.

    Decoded bytes that differ from the text are an error.
    """
    raw, at = utf8(batch.column("text"))
    counts = np.zeros(batch.num_rows, np.int64)
    whole, back = ([hashlib.sha256() for _ in range(batch.num_rows)] for _ in range(2))
    for part, ends in codec.pieces(raw, at):
        ids, places = codec.encode(part, ends)
        seen(ids)
        counts += np.diff(places)
        flat, cuts = ids.astype("<u4").tobytes(), (4 * places).tolist()
        for h, a, b in zip(whole, cuts, cuts[1:], strict=False):
            h.update(flat[a:b])
        done = ends[:-1].copy()
        for d, text in codec.decode(ids, places):
            if part[done[d] : done[d] + len(text)].tobytes() != text:
                raise ValueError("decoded ids differ from their text")
            done[d] += len(text)
            back[d].update(text)
        if (done != ends[1:]).any():
            raise ValueError("decoded ids fall short of their text")
    return counts, [h.hexdigest() for h in whole], [h.hexdigest() for h in back]


def _encoder(raw: bytes, schema: pa.Schema):
    def encode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec(raw) as codec:
            for batch in batches(source, CHUNK_BYTES):
                parts = [codec.encode(*p) for p in codec.pieces(*utf8(batch.column("text")))]
                ids, counts = np.concatenate([i for i, _ in parts]), sum(np.diff(a) for _, a in parts)
                yield record(schema, doc_id=batch.column("doc_id"), n_tokens=counts, ids=pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), ids.astype(np.int32)))

    return encode


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) by the rank file at ``path``; null and empty texts have no ids.

    Texts are split by the pattern of the public byte-level vocabularies; no special tokens. Repeated rows are
    encoded alike, null ids and ids of any type kept, other columns dropped; an empty table gives no rows. A long
    text is taken in pieces of about a megabyte, cut where the pattern cuts; a word of n bytes takes time in
    proportion to n, in windows.
    """
    fields, schema = by_document(docs, "n_tokens long, ids array<int>")
    return docs.select("doc_id", "text").mapInArrow(_encoder(load(path), schema), fields)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) for rows (doc_id, ids); null ids decode to nothing."""
    raw, (fields, schema) = load(path), by_document(encoded, "decoded binary")

    def decode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec(raw) as codec:
            for batch in source:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    lists = part.column("ids").fill_null([]) if part.column("ids").null_count else part.column("ids")
                    counts = np.array([len(x) for x in lists], np.int64)
                    out: list[list[bytes]] = [[] for _ in range(len(counts))]
                    for d, text in codec.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(counts)))):
                        out[d].append(text)
                    yield record(schema, doc_id=part.column("doc_id"), decoded=[b"".join(t) for t in out])

    return encoded.select("doc_id", "ids").mapInArrow(decode, fields)


def _digests(raw: bytes, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec(raw) as codec:
            for batch in batches(source, CHUNK_BYTES):
                counts, ids, decoded = _coded(codec, batch, lambda _: None)
                yield record(schema, doc_id=batch.column("doc_id"), n_tokens=counts, ids_sha256=ids, decoded_sha256=decoded)

    return run


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents; see ``encode_documents`` for nulls, empty and long texts."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fields, schema = by_document(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.mapInArrow(_digests(load(public_tokenizers.path("byte_bpe_50k.tiktoken")), schema), fields)


def _round_trip(raw: bytes, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec(raw) as codec:
            for batch in batches(source, CHUNK_BYTES):
                parts: list[np.ndarray] = []
                counts, _, decoded = _coded(codec, batch, parts.append)
                ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), np.concatenate(parts).astype(np.int32))
                yield record(schema, doc_id=batch.column("doc_id"), n_tokens=counts, ids=ids, decoded_sha256=decoded)

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row that is left, and the digest of the bytes they decode to, which must be the text's.

    Nulls, empty and long texts, repeated rows and clashing columns are as in ``encode_documents``.
    """
    import public_tokenizers

    fields, schema = by_document(docs, "n_tokens long, ids array<int>, decoded_sha256 string")
    return docs.select("doc_id", "text").mapInArrow(_round_trip(load(public_tokenizers.path("byte_bpe_50k.tiktoken")), schema), fields)
