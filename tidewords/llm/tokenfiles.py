"""Token ids in Parquet: list columns with dictionary or delta encoding, small pages, page indexes, selective reads."""

from __future__ import annotations

import os
import string
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from tidewords.llm.bpe import load
from tidewords.llm.common import batches, by_document, give_back, read, record, utf8, words
from tidewords.sources.shared import shared_folder

#: Bytes of texts taken at once, words whose ids a worker keeps, words of one call of the library.
CHUNK_BYTES, KEPT_WORDS, ASKED = 3 << 20, 400_000, 1 << 14
#: The id that ends each document.
END = 1
#: Most encoded bytes of a row group and a page, and most rows of a page. Documents are few to a page, as one reads some of them.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 64 << 10, 256


#: Classes of bytes: letters, digits, others, and those of further characters, which may be anything.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 3
_KIND[[ord(c) for c in string.ascii_letters]], _KIND[[ord(c) for c in string.digits]] = 1, 2


class WordEncoder:
    """Ids by a tokenizers file. The library is asked once for each distinct piece of a text.

    For tokenizers that split texts at white space, which they drop, and at borders of letters, digits and other signs (but what
    follows an apostrophe) before anything else, don't tell case apart and end each piece with a token of its own, as
    ``path``'s does: then a text's ids are those of its pieces, one after another. Texts that may hold special tokens are
    only cut at white space.
    """

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        pieces = ["ab", "7", "8", "(", "cd", "'s", "-'", "ef"]
        if ids(" Ab78 \t\n\v\f\r(cd's-'ef ") != [i for p in pieces for i in ids(p)]:
            raise ValueError("this tokenizer keeps white space or case, or doesn't part letters, digits and signs")
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("this tokenizer doesn't mark the ends of pieces")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.known: dict[bytes, int] = {}  # the row of a piece in the next two
        self.flat, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, missing: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and how many each has. Those of ASCII letters are one token run each, so they are asked for together."""
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        plain = [w.isalpha() for w in missing]  # of bytes: ASCII letters
        for k in range(0, len(missing), ASKED):
            some, simple = missing[k : k + ASKED], np.array(plain[k : k + ASKED], bool)
            joined = b" ".join(w for w, one in zip(some, simple, strict=True) if one).decode()
            odd = [w.decode("utf-8", "surrogatepass") for w, one in zip(some, simple, strict=True) if not one]
            got = self.tokenizer.encode_batch_fast([joined, *odd], add_special_tokens=False)
            together, listed = np.array(got[0].ids, np.int32), [e.ids for e in got[1:]]
            n = np.zeros(len(some), np.int64)
            n[simple] = np.diff(np.flatnonzero(self.ends[together]) + 1, prepend=0)
            n[~simple] = np.fromiter(map(len, listed), np.int64, len(listed))
            out = np.empty(n.sum(), np.int32)
            mine = np.repeat(simple, n)
            out[mine], out[~mine] = together, np.fromiter(chain.from_iterable(listed), np.int32, (~mine).sum())
            counts.append(n)
            flat.append(out)
        return np.concatenate(flat), np.concatenate(counts)

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The text of each piece, and all pieces in order."""
        if b"<|" in raw.tobytes():
            return words(raw, at)
        kind = _KIND[raw]
        capital = (raw >= 65) & (raw <= 90) & np.append(raw[1:] < 128, True)  # a mark after it may make both one character
        raw = np.where(capital, raw + np.uint8(32), raw)
        parted = np.zeros(len(raw), bool)
        a, b = kind[:-1], kind[1:]
        parted[1:] = (a > 0) & (b > 0) & ((a != b) | (a == 2)) & (raw[:-1] != 39)
        return words(raw, at, parted)

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie end to end, each with the id that ends it, and offsets by text."""
        doc, listed = self._pieces(raw, at)
        coded = listed.dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        row = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        absent = np.flatnonzero(row < 0)
        missing = [distinct[i] for i in absent.tolist()]
        new, n_new = self._learn(missing)
        row[absent] = np.arange(len(self.counts), len(self.counts) + len(missing))
        flat, counts = np.concatenate((self.flat, new)), np.concatenate((self.counts, n_new))
        keep = min(len(missing), max(0, KEPT_WORDS - len(self.counts)))
        if keep:
            self.known.update(zip(missing[:keep], row[absent[:keep]].tolist(), strict=True))
            self.counts = counts[: len(self.counts) + keep]
            self.flat = flat[: self.counts.sum()]
        row = row[index]
        starts, n = (np.cumsum(counts) - counts)[row], counts[row]
        offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, n, len(at) - 1).astype(np.int64) + 1)))
        out = np.full(offsets[-1], END, np.int32)
        place = np.cumsum(n) - n  # of a piece's ids, were there no end ids
        which = np.arange(n.sum())
        out[which + np.repeat(doc, n)] = flat[which + np.repeat(starts - place, n)]
        return out, offsets


@lru_cache(1)
def _encoder(raw: bytes) -> WordEncoder:
    """A worker's encoder, which its later tasks use again with the words that it knows."""
    return WordEncoder(raw)


def _tokenise(raw: bytes, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = _encoder(raw), 0
        for batch in batches(source, CHUNK_BYTES):
            ids, offsets = encoder.encode(*utf8(batch.column("text")))
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), ids)
            yield record(schema, doc_id=batch.column("doc_id"), at=before + offsets[:-1], n_tokens=np.diff(offsets), ids=lists)
            before += int(offsets[-1])
        give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> None:
    """Write the token ids of ``docs`` to ``path`` in ascending order of doc_id: (doc_id, at, n_tokens, ids).

    Rows are dealt by ranges of doc_id, so that file after file and row after row ids ascend; equal ids follow
    the hash of their texts, null ids come first. ``at`` counts the ids before a row in its part. Token ids are
    dictionary-encoded and bit-packed, ids and counts, which ascend or are small, as deltas. Pages are small and have
    a column index, so that readers of some documents or of the counts alone read little else. Null and empty
    texts have the end id alone, repeated rows are rows like any other, other columns are dropped, an empty table makes
    no rows. A text's distinct words are held in memory, not its tokens' descriptions.
    """
    fields, schema = by_document(docs, "at long, n_tokens long, ids array<int>")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    rows = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "v2", "compression": "zstd"}
    options |= {"parquet.enable.dictionary": "true"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "at", "n_tokens")}
    rows.mapInArrow(_tokenise(load(tokenizer), schema), fields).write.options(**options).parquet(path)


def _stored(spark: SparkSession, path: str, id_type: DataType) -> DataFrame:
    """The rows as they lie in the files, and the part each is of."""
    schema = StructType([StructField("doc_id", id_type), *StructType.fromDDL("at long, n_tokens long, ids array<int>")])
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return spark.read.schema(schema).parquet(path).withColumn("part", part)


def _with_start(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows (part, at) with start; what a part adds is read from counts alone. One row a part is broadcast."""
    ends = stored.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("held"))
    before = F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ends.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("at")).drop("before", "part", "at")


def read_index(spark: SparkSession, path: str, id_type: DataType = LongType()) -> DataFrame:
    """(doc_id, n_tokens, start) of written tokens; the ids' pages are not read."""
    stored = _stored(spark, path, id_type)
    return _with_start(stored.select("doc_id", "part", "at", "n_tokens"), stored)


def read_documents(spark: SparkSession, path: str, chosen: Column, id_type: DataType = LongType()) -> DataFrame:
    """(doc_id, n_tokens, ids) where ``chosen``, a condition on doc_id or n_tokens, holds; page indexes skip the rest."""
    return _stored(spark, path, id_type).where(chosen).select("doc_id", "n_tokens", "ids")


def _checksums(schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = batch.column("ids")
            data, ends = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4"), lists.offsets.to_pylist()
            if np.diff(ends).tolist() != batch.column("n_tokens").to_pylist():
                raise ValueError("a row's ids are not as many as it says")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield record(schema, **{c: batch.column(c) for c in schema.names[:-1]}, ids_crc32=crc)

    return run


def read_checksums(spark: SparkSession, path: str, id_type: DataType = LongType()) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, start) of written tokens; the checksum is of the ids as little-endian unsigned 32-bit integers."""
    stored = _stored(spark, path, id_type)
    fields, schema = by_document(stored, "part int, at long, n_tokens long, ids_crc32 long")
    return _with_start(stored.select("doc_id", "part", "at", "n_tokens", "ids").mapInArrow(_checksums(schema), fields), stored)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written to the shared folder and read back; see ``write_tokens`` for odd rows."""
    import public_tokenizers

    docs, path = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_checksums(spark, path, docs.schema["doc_id"].dataType).select("doc_id", "start", "n_tokens", "ids_crc32")
