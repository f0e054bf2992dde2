"""Steps over a key's rows in order of time: rows wait in the state until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A step takes the key's value, its state (None at first) and a row, and gives the next state (None: none) and what is told.
Step = Callable[[object, "tuple | None", tuple], "tuple[tuple | None, list[tuple]]"]

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WHOLE = ("tinyint", "smallint", "int", "bigint")

#: Groups that keys are dealt into: keys of a group share a call of Python, which costs some 7 ms however few rows it has.
BUCKETS = 2048


def _values(column: pd.Series, whole: bool) -> list:
    """A column's values, None where there is none; whole numbers stay whole beside them."""
    if not column.hasnans:
        return column.tolist()
    return [None if v is None or v != v else int(v) if whole else v for v in column.tolist()]


def _columns(rows: list[tuple], n: int) -> list[list]:
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(n)]


def in_order(stream: DataFrame, key: str, columns: list[str], step: Step, state: str, out: str, ends: Callable[[tuple], int | None] = lambda _: None, ended: Callable[[object, tuple], list[tuple]] = lambda *_: [], buckets: int = BUCKETS) -> DataFrame:
    """(key, ``out``…): what ``step`` tells of a key's rows (at_ms, event_id, ``columns``…), one after another in order of time and event_id.

    ``stream`` has a watermark on event time, ``at``. A row waits until the watermark has passed it, so that files may come in any
    order within the watermark's delay and batches may be small; rows behind the watermark are dropped as late. A key holds
    the rows within the delay and its state. When the watermark has passed ``ends(state)`` with no row before it, ``ended`` tells the
    rest and the state goes.

    Keys are dealt by hash into ``buckets``, which a checkpoint is bound to. A bucket's rows and states, a list a column, come and go with a
    batch's rows; it is called when it has new rows and when the watermark has passed the first row or end that it holds.
    The state store is on RocksDB, off the heap, which is set for the session's later queries.
    """
    spark = stream.sparkSession
    if spark.conf.get(_PROVIDER) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    fields = ["__key", "at_ms", "event_id", *columns]
    named = stream.withColumn("__key", F.nullif(F.col(key).cast("string"), F.lit("")))
    types = {f.name: f.dataType.simpleString() for f in named.schema}
    whole = [types[c] in _WHOLE for c in fields]
    parts_of = lambda ddl: [part.split() for part in ddl.split(", ")]
    told = ["__key", *(c for c, _ in parts_of(out))]
    kept = [*(f"row_{c.strip('_')} array<{types[c]}>" for c in fields), "key array<string>", *(f"now_{c} array<{kind}>" for c, kind in parts_of(state))]

    def take(_: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        had = held.get if held.exists else [[] for _ in kept]
        rows = list(zip(*had[: len(fields)], strict=True))
        states = {name: now for name, *now in zip(*had[len(fields) :], strict=True)}
        states = {name: tuple(now) for name, now in states.items()}
        if not held.hasTimedOut:
            for part in parts:
                rows += zip(*(_values(part[c], w) for c, w in zip(fields, whole, strict=True)), strict=True)
        passed = held.getCurrentWatermarkMs()
        some: list[tuple] = []
        for name, *row in sorted((r for r in rows if r[1] <= passed), key=lambda r: r[1:3]):
            states[name], what = step(name, states.get(name), tuple(row))
            some += [(name, *t) for t in what]
        rows = [r for r in rows if r[1] > passed]
        due = [min(r[1] for r in rows)] if rows else []
        for name, now in list(states.items()):
            end = None if now is None else ends(now)
            if end is not None and end <= passed:  # what still waits comes later
                some += [(name, *t) for t in ended(name, now)]
                now = None
            if now is None:
                del states[name]
            elif end is not None:
                due.append(end)
        if rows or states:
            held.update((*_columns(rows, len(fields)), *_columns([(name, *now) for name, now in states.items()], len(kept) - len(fields))))
            if due:  # the call comes when the watermark is beyond the timeout
                held.setTimeoutTimestamp(max(min(due) - 1, passed, 1))
        elif held.exists:
            held.remove()
        if some:
            yield pd.DataFrame(some, columns=told)

    dealt = named.select(F.pmod(F.xxhash64("__key"), F.lit(buckets)).alias("__bucket"), "at", *fields)
    done = dealt.groupBy("__bucket").applyInPandasWithState(take, f"__key string, {out}", ", ".join(kept), "append", GroupStateTimeout.EventTimeTimeout)
    return done.select(F.col("__key").cast(types[key]).alias(key), *told[1:])
