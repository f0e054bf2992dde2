"""What the operators of this subpackage share: reading, splits, Arrow access and reliable lineage cuts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewords.sources.shared import shared_folder

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """True for the documents kept from training: crc32 of the id's text leaves no remainder.

    A null id counts as not held out and is never learnt from (callers filter on ``== False``).
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint in the folder all executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def by_document(docs: DataFrame, ddl: str) -> tuple[StructType, pa.Schema]:
    """The columns of a result that has ``docs``' doc_id, of whatever type, and then those of ``ddl``."""
    fields = StructType([docs.schema["doc_id"], *StructType.fromDDL(ddl)])
    return fields, to_arrow_schema(fields)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and n + 1 offsets into them. Null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(at) and at[-1] else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` each; a longer row stands alone, so that memory stays bounded."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), start + most_rows, n)
        yield start, end
        start = end


def batches(source: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int = 1 << 30, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size."""
    for batch in source:
        if batch.num_rows:
            _, offsets = utf8(batch.column(text))
            for start, end in slices(offsets, most_bytes, most_rows):
                yield batch.slice(start, end - start)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Each text of the column as UTF-8 bytes; null as empty."""
    raw, at = utf8(batch.column(name))
    whole, ends = raw.tobytes(), at.tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_GAP = re.compile(rb"[ \t-\r]")


def words(raw: np.ndarray, at: np.ndarray, parted: np.ndarray | None = None) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """The words of texts that lie end to end: the text of each, and all of them in order. Bytes that are ``parted`` begin one too."""
    blank = _BLANK[raw]
    begins = ~blank
    begins[1:] &= blank[:-1] if parted is None else blank[:-1] | parted[1:]
    heads = at[:-1][at[:-1] < len(raw)]
    begins[heads] = ~blank[heads]
    starts = np.flatnonzero(begins)
    gaps = np.flatnonzero(blank)
    ends = np.append(starts - np.searchsorted(gaps, starts), len(raw) - len(gaps))
    data = np.ascontiguousarray(raw[~blank])
    return np.searchsorted(at, starts, "right") - 1, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def segments(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut in white space; at least one."""
    at = 0
    while True:
        gap = _GAP.search(text, at + size)
        stop = gap.start() if gap else len(text)
        yield text[at:stop]
        if stop == len(text):
            return
        at = stop


def give_back() -> None:
    """Return freed memory to the system; a worker outlives its task and stands beside the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
