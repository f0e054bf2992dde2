"""Quality rules: text statistics, and compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidewords.llm.common import batches, by_document, read, record, texts, utf8, words

LEVEL, CHUNK, LEAST_TAIL = 3, 4096, 1024
#: Bytes from which a band holds, the least and the most of raw / compressed that it allows. Chunks use the band of their own length.
#: The least lies between random text (letters and digits, base64) and the clean texts of that length, the most between clean
#: texts and those of few word pieces or of signs after every word; README has the measured ratios.
BANDS = (
    (0, 0.0, 2.6), (256, 1.25, 2.1), (512, 1.35, 2.1), (1024, 1.5, 2.13), (1448, 1.5, 2.21), (2048, 1.5, 2.25), (2896, 1.6, 2.29), (4096, 1.85, 2.36),
    (5793, 1.85, 2.42), (8192, 1.85, 2.48), (11585, 1.85, 2.52), (16384, 1.85, 2.58), (32768, 1.85, 2.66), (65536, 1.85, 2.76), (131072, 1.85, 2.86), (1 << 20, 1.85, 3.2),
)
#: A document is rejected if more than this share of the bytes in judged chunks lies outside the band.
BAD_SHARE = 0.3
#: Three-word windows that are sorted at once.
WINDOWS = 1 << 21
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def repeat_words(text: np.ndarray, found: pa.LargeBinaryArray, n: int) -> np.ndarray:
    """For each of n texts, the words that lie in a three-word window found twice or more in it, the first included.

    Windows are numbered pair by pair and sorted in parts by a scrambled key, so that memory stays bounded.
    """
    if len(found) < 3:
        return np.zeros(n, np.int64)
    word = found.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    inside = np.flatnonzero(text[2:] == text[:-2])
    pair = (text[inside] << 24 ^ word[inside]) << 24 ^ word[inside + 1] if word.max() < 1 << 24 and n < 1 << 15 else np.unique(np.column_stack((text[inside], word[inside], word[inside + 1])), axis=0, return_inverse=True)[1].ravel()
    third, again = word[inside + 2], np.zeros(len(inside), bool)
    part = (pair * np.int64(0x9E3779B97F4A7C1) + third * np.int64(0x85EBCA6B1) >> 40) % max(1, -(-len(inside) // WINDOWS))
    for k in range(int(part.max(initial=-1)) + 1):
        some = np.flatnonzero(part == k)
        order = some[np.lexsort((third[some], pair[some]))]
        same = (pair[order][1:] == pair[order][:-1]) & (third[order][1:] == third[order][:-1])
        again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[inside[again] + k] = True
    return np.bincount(text[covered], minlength=n)


def outside(n: int, ratio: float) -> bool:
    """Is a ratio of a text of n bytes outside its band?"""
    low, high = next((low, high) for least, low, high in reversed(BANDS) if n >= least)
    return not low <= ratio <= high


def compression(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Raw over compressed size of the whole, and the share of judged bytes whose chunk is outside its band.

    A last chunk shorter than ``LEAST_TAIL`` isn't judged beside others; an empty text has ratio 1.
    """
    if not text:
        return 1.0, 0.0
    ratio = len(text) / len(zstd.compress(text))
    if len(text) <= CHUNK:
        return ratio, float(outside(len(text), ratio))
    judged = bad = 0
    for k in range(0, len(text), CHUNK):
        part = text[k : k + CHUNK]
        if len(part) >= LEAST_TAIL:
            judged += len(part)
            bad += len(part) * outside(len(part), len(part) / len(zstd.compress(part)))
    return ratio, bad / judged


def _judge(schema: pa.Schema):
    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches(source, 8 << 20):
            raw, at = utf8(batch.column("text"))
            n = batch.num_rows
            within = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), at))
            text, found = words(raw, at)
            n_words = np.bincount(text, minlength=n)
            repeats = repeat_words(text, found, n)
            letters = np.diff(np.frombuffer(found.buffers()[1], np.int64)[np.searchsorted(text, np.arange(n + 1))]) if len(found) else np.zeros(n, np.int64)
            failed = (n_words < 50) | (100 * repeats > 50 * n_words)
            dup, ratios, bad = [], [], []
            for t in texts(batch):
                lines = [line for line in t.split(b"\n") if line.strip()]
                dup.append(len(lines) - len(set(lines)))
                for out, x in zip((ratios, bad), compression(t, zstd), strict=True):
                    out.append(x)
            out = [outside(k, r) or b > BAD_SHARE for k, r, b in zip(np.diff(at).tolist(), ratios, bad, strict=True)]
            yield record(
                schema, doc_id=batch.column("doc_id"), n_words=n_words, word_chars=letters - within(raw & 0xC0 == 0x80), n_symbols=within(_SYMBOLS[raw]), n_dup_lines=dup,
                n_repeat_words=repeats, base_failed=failed, kept=~failed & ~np.array(out, bool), ratio=ratios, bad_chunks=bad,
            )

    return judge


def quality_rules(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of each document, row by row: its doc_id and the columns of ``DDL``.

    A document is kept if it passes the base rules, its ratio of raw to compressed bytes lies in the band of its
    length, and so do the ratios of most of its chunks. Null and empty texts have no words and fail the base rules.
    Repeated rows are judged alike; null ids and ids of any type are kept; other columns are dropped; a long text is
    judged whole, its windows sorted in parts; an empty table gives no rows.
    """
    fields, schema = by_document(docs, DDL)
    return docs.select("doc_id", "text").mapInArrow(_judge(schema), fields)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; see ``quality_rules`` for nulls, empty and long texts and repeated rows."""
    return quality_rules(read(spark, sf_dir, "documents"))
