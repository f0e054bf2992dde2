"""Interval functions for SQL: table functions over spans in order, a batch of rows at a time, with one span of memory a partition.

    register(spark)
    SELECT * FROM merge_spans(TABLE(spans) PARTITION BY rec_id ORDER BY (s, e))
    SELECT * FROM silences(TABLE(spans) PARTITION BY rec_id ORDER BY (s, e), 300)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf


def _columns(rows: pa.Table) -> tuple[object, np.ndarray, np.ndarray]:
    """A partition's recording, and starts and ends of the spans that last."""
    s, e = (np.asarray(rows.column(c)).astype(np.int64) for c in ("s", "e"))
    return rows.column("rec_id")[0].as_py(), s, e


@arrow_udtf(returnType="rec_id bigint, s bigint, e bigint")
class MergeSpans:
    """Spans (rec_id, s, e) joined where they overlap or touch; rows come by recording and start."""

    def __init__(self) -> None:
        self.rec, self.open = None, None

    def eval(self, rows: pa.Table) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return
        self.rec, s, e = _columns(rows)
        lasts = e > s
        s, e = s[lasts], e[lasts]
        if self.open is not None:
            s, e = np.concatenate(([self.open[0]], s)), np.concatenate(([self.open[1]], e))
        if not len(s):
            return
        reach = np.maximum.accumulate(e)
        begins = np.concatenate(([0], np.flatnonzero(s[1:] > reach[:-1]) + 1))
        ends = reach[np.concatenate((begins[1:], [len(s)])) - 1]
        self.open = int(s[begins[-1]]), int(ends[-1])
        if len(begins) > 1:
            yield pa.table({"rec_id": [self.rec] * (len(begins) - 1), "s": s[begins[:-1]], "e": ends[:-1]})

    def terminate(self) -> Iterator[pa.Table]:
        if self.open is not None:
            yield pa.table({"rec_id": [self.rec], "s": [self.open[0]], "e": [self.open[1]]})


@arrow_udtf(returnType="rec_id bigint, start_ms bigint, end_ms bigint")
class Silences:
    """Gaps of ``least`` ms or more before and between spans (rec_id, s, e) that come by recording and start, and up to ``total`` if rows have that column."""

    def __init__(self) -> None:
        self.rec, self.reached, self.least, self.total = None, 0, 0, None

    def eval(self, rows: pa.Table, least: pa.Array) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return
        self.rec, s, e = _columns(rows)
        self.least = least[0].as_py() if hasattr(least, "__getitem__") else int(least)
        if "total" in rows.schema.names:
            self.total = rows.column("total")[0].as_py()
        before = np.maximum.accumulate(np.concatenate(([self.reached], e)))
        self.reached = int(before[-1])
        hit = np.flatnonzero(s - before[:-1] >= self.least)
        if len(hit):
            yield pa.table({"rec_id": [self.rec] * len(hit), "start_ms": before[hit], "end_ms": s[hit]})

    def terminate(self) -> Iterator[pa.Table]:
        if self.total is not None and self.total - self.reached >= self.least:
            yield pa.table({"rec_id": [self.rec], "start_ms": [self.reached], "end_ms": [self.total]})


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    spark.udtf.register("merge_spans", MergeSpans)
    spark.udtf.register("silences", Silences)
