"""Streaming operators over job events; those that go by a job's order let rows wait for the watermark, which drops what comes later."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewords.functions.scalar import power_db

from tidewords.sources.shared import settle, shared_folder
from tidewords.streaming.ordered import in_order

#: Milliseconds of a time without zone, whatever the session's zone is.
MILLIS = "unix_millis(to_utc_timestamp(cast({} as timestamp), current_timezone()))"


def event_stream(spark: SparkSession, sf_dir: str, delay: str = "1 hour", files_a_batch: int | None = None, closing: str | None = None) -> DataFrame:
    """The events as a stream with a watermark on ``at``, and ``at_ms``; the table is one file or a folder of part files.

    Unless ``files_a_batch`` is given all files that are there come in one batch. With it, rows may come in any order
    within ``delay``; later ones are dropped. Rows of the folder ``closing`` are read too (see ``close``).
    """
    table = f"{sf_dir}/events.parquet"
    store, named = _store(spark, table)
    folder = store.getFileStatus(named(table)).isDirectory()
    files = spark.readStream.schema(spark.read.parquet(table).schema)
    files = files.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else files
    stream = files.parquet(table) if folder else files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    if closing:
        spark.createDataFrame([], stream.schema).write.parquet(closing)
        stream = stream.unionByName(spark.readStream.schema(stream.schema).parquet(closing))
    return stream.withColumn("at", F.col("ts").cast("timestamp")).withColumn("at_ms", F.expr(MILLIS.format("ts"))).withWatermark("at", delay)


def close(spark: SparkSession, sf_dir: str, closing: str, delay: str = "1 hour") -> None:
    """Put a row of nobody into the folder ``closing``, so late that the watermark passes all events; it waits itself and is never told."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select((F.col("ts") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 minute")).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    last.select(*(F.col(c) if c in last.columns else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns)).write.mode("append").parquet(closing)


def drained(stream: DataFrame, keys: list[str] | None = None, end: Callable[[], None] | None = None) -> DataFrame:
    """What a stream has given when all that was there is read: written batch by batch, then read as a table.

    Rows are appended as they are final; with ``keys`` the stream runs in update mode and the last row of each key stays.
    A batch that runs again writes its own folder again. Windows and sessions that the watermark has not passed are open
    and give nothing yet. With ``end``, which may add a closing row to the source, the stream goes on from its checkpoint after it.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    done: list[str] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/{n}")
        if f"{base}/out/{n}" not in done:
            done.append(f"{base}/out/{n}")

    run = lambda: stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    run()
    if end:
        end()
        run()
    told = StructType([*stream.schema, *StructType.fromDDL("__batch long")])
    out = spark.read.schema(told).parquet(*done) if done else spark.createDataFrame([], told)
    if keys:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__batch")))
        out = out.withColumn("__last", last).where("__last = 1").drop("__last")
    return out.drop("__batch")


def _store(spark: SparkSession, path: str):
    """The file system of a path, and how it names paths."""
    named = spark._jvm.org.apache.hadoop.fs.Path
    return named(path).getFileSystem(spark._jsc.hadoopConfiguration()), named


def _versions(spark: SparkSession, table: str) -> list[int]:
    """The versions whose manifest is committed."""
    store, named = _store(spark, table)
    at = named(f"{table}/manifest")
    return sorted(int(f.getPath().getName()) for f in store.listStatus(at) if store.exists(named(f.getPath(), "_SUCCESS"))) if store.exists(at) else []


def _manifest(spark: SparkSession, table: str, version: int) -> dict[int, str]:
    """The folder of each bucket that holds rows in a version: as many as buckets."""
    return {r.bucket: r.folder for r in spark.read.schema("bucket int, folder string").parquet(f"{table}/manifest/{version}").collect()}


def apply_batch(batch: DataFrame, n: int, table: str, key: str, buckets: int = 64) -> None:
    """Put a batch's last transition of each job into the table, as version ``n`` after the version before.

    Jobs are dealt into ``buckets`` by hash. Only buckets that the batch has jobs of are read and written, to a folder of the
    version; the manifest, written last, says for each bucket which version's folder holds it. A batch that runs again starts from
    the version before it and writes the same folders again; one that fails leaves the table as it was. Folders that
    neither this version nor the one before names are removed.
    """
    spark = batch.sparkSession
    fields = [c for c in batch.columns if c != key]
    last = F.max_by(F.struct(*fields), F.struct("at_ms", "event_id")).alias("s")
    new = batch.groupBy(key).agg(last).select(key, "s.*").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    new = settle(new)
    earlier = [v for v in _versions(spark, table) if v < n]
    held = _manifest(spark, table, earlier[-1]) if earlier else {}
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # no more than buckets
    rows = new
    if known := [held[b] for b in touched if b in held]:
        old = spark.read.schema(batch.select(key, *fields).schema).parquet(*(f"{table}/{f}" for f in known))
        old = old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        order = lambda d, late: d.withColumn("__late", F.lit(late))
        rows = order(old, 0).unionByName(order(new, 1)).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at_ms"), F.desc("event_id"), F.desc("__late"))))
        rows = rows.where("__n = 1").drop("__n", "__late")
    if touched:
        rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/data/{n}")
    now = held | {b: f"data/{n}/bucket={b}" for b in touched}
    spark.createDataFrame(list(now.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/{n}")
    _sweep(spark, table, set(now.values()) | set(held.values()), keep=[n, *earlier[-1:]])


def _sweep(spark: SparkSession, table: str, used: set[str], keep: list[int]) -> None:
    """Remove bucket folders and manifests of versions that nothing reads any more."""
    store, named = _store(spark, table)
    for version in store.listStatus(named(f"{table}/data")) if store.exists(named(f"{table}/data")) else []:
        folders = [f.getPath() for f in store.listStatus(version.getPath()) if f.isDirectory() and f.getPath().getName().startswith("bucket=")]
        gone = [f for f in folders if f"data/{version.getPath().getName()}/{f.getName()}" not in used]
        for f in gone if len(gone) < len(folders) else [version.getPath()]:
            store.delete(f, True)
    for v in _versions(spark, table):
        if v < min(keep):
            store.delete(named(f"{table}/manifest/{v}"), True)


def job_table(stream: DataFrame, table: str, key: str, buckets: int = 64) -> None:
    """Keep a table of the last state of each job, a version a batch, in a folder of the shared store; see ``apply_batch``."""
    step = lambda batch, n: apply_batch(batch, n, table, key, buckets)
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{table}-state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


def read_job_table(spark: SparkSession, table: str, version: int | None = None) -> DataFrame | None:
    """The newest version (up to ``version``) of a table that ``job_table`` keeps, None before the first. The last two are kept."""
    there = [n for n in _versions(spark, table) if version is None or n <= version]
    folders = list(_manifest(spark, table, there[-1]).values()) if there else []
    return spark.read.parquet(*(f"{table}/{f}" for f in folders)) if folders else None


def latest_state(stream: DataFrame, job: str) -> DataFrame:
    """The last event of each job."""
    last = F.max(F.struct("at_ms", "event_id", "event_type")).alias("last")
    return stream.groupBy(job).agg(last).select(job, "last.event_id", "last.event_type")


def load(stream: DataFrame, width: str = "1 minute") -> DataFrame:
    """Events by type in tumbling windows."""
    counted = stream.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.expr(MILLIS.format("cast(w.start as timestamp_ntz)")).alias("start_ms"), "event_type", "n")


def energy(stream: DataFrame, width: str = "10 milliseconds") -> DataFrame:
    """Events and the mean square of their values in tumbling windows."""
    met = stream.groupBy(F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.avg(F.col("value") * F.col("value")).alias("power"))
    return met.select(F.expr(MILLIS.format("cast(w.start as timestamp_ntz)")).alias("start_ms"), "n", "power")


def level(stream: DataFrame, width: str = "10 seconds", step: str = "1 second", block: str = "50 milliseconds", q: float = 0.95, resolution_db: float = 0.5) -> DataFrame:
    """(start_ms, n, loudest, level_db) in sliding windows: blocks of the signal, the loudest one's mean square, and the level that a share ``q`` of them keep below.

    Blocks are counted by steps of ``resolution_db`` from -120 dB on, and steps summed up by window: a sketch that adds up over
    tasks and batches, of some hundred counts at most. ``level_db`` is the lower edge of the step that has the block at
    floor((n - 1) * q) in order of loudness, so it is up to one step below that block's own level.
    """
    blocks = stream.groupBy(F.window("at", block).alias("b")).agg(F.avg(F.col("value") * F.col("value")).alias("power"))
    stepped = blocks.select(F.window_time("b").alias("at"), "power", F.floor(power_db(F.col("power")) / resolution_db).cast("int").alias("step"))
    counts = stepped.groupBy(F.window("at", width, step).alias("w"), "step").agg(F.count("*").alias("n"), F.max("power").alias("power"))
    sketch = counts.groupBy("w").agg(F.sum("n").alias("n"), F.max("power").alias("loudest"), F.array_sort(F.collect_list(F.struct("step", "n"))).alias("steps"))
    at = F.floor((F.col("n") - 1) * q)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("step"))
    found = F.aggregate("steps", start, lambda acc, x: F.struct((acc["seen"] + x["n"]).alias("seen"), F.coalesce(acc["step"], F.when(acc["seen"] + x["n"] > at, x["step"])).alias("step")))
    return sketch.select(F.expr(MILLIS.format("cast(w.start as timestamp_ntz)")).alias("start_ms"), "n", "loudest", (found["step"] * resolution_db).alias("level_db"))


def idle_sessions(stream: DataFrame, user: str, idle_ms: int = 60_000, most_ms: int = 7_200_000) -> DataFrame:
    """(user, start_ms, last_ms, n, reason): sessions of a user's events, closed by an idle gap or by their length.

    An event later than ``idle_ms`` after the last one opens a new session, as does one ``most_ms`` or more after the
    session's start. A session that is idle is given out when the watermark has passed, and its state goes.
    """

    def step(_, state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        at = row[0]
        if state is None:
            return (at, at, 1), []
        start, last, n = state
        if at - last > idle_ms or at - start >= most_ms:
            return (at, at, 1), [(start, last, n, "idle" if at - last > idle_ms else "length")]
        return (start, at, n + 1), []

    out = "start_ms long, last_ms long, n long, reason string"
    return in_order(stream, user, [], step, "start long, last long, n long", out, lambda s: s[1] + idle_ms + 1, lambda _, s: [(*s, "idle")])


def stage_progress(stream: DataFrame, job: str, stage: str, running: str = "view", ended: tuple[str, ...] = ("purchase", "error"), stages: str = "click", most_ms: int = 86_400_000) -> DataFrame:
    """(job, event_id, stage, percent): stage events of jobs that are running; others pass unseen.

    A job's state is its last status; it goes when the job ends or the watermark is ``most_ms`` past its last status.
    """
    percent = {"decode": 10, "vad": 25, "asr": 40, "assemble": 95}

    def step(_, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        at, event, kind, name = row
        if kind != stages:
            return (None if kind in ended else (kind, at)), []
        return state, [(event, name, percent.get(name, 0))] if state and state[0] == running else []

    return in_order(stream, job, ["event_type", stage], step, "status string, at long", "event_id long, stage string, percent int", lambda s: s[1] + most_ms)


def once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each event once, however often it is delivered within the watermark's delay."""
    return stream.dropDuplicatesWithinWatermark(keys)


def number_events(stream: DataFrame, job: str, terminal: str = "error", most_ms: int = 30 * 86_400_000) -> DataFrame:
    """(job, event_id, seq): numbers from 1 in each topic of a job.

    A terminal event closes the topic, and the next event opens another; one that would open a topic is ignored. A
    job's state goes with its topic, or when the watermark is ``most_ms`` past its last event.
    """

    def step(_, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        at, event, kind = row
        seq = state[0] + 1 if state else 1
        if kind == terminal:
            return None, [(event, seq)] if state else []
        return (seq, at), [(event, seq)]

    return in_order(stream, job, ["event_type"], step, "seq long, at long", "event_id long, seq long", lambda s: s[1] + most_ms)


def token_bucket(stream: DataFrame, key: str, rate: float, capacity: float | None = None) -> DataFrame:
    """(key, event_id, allowed, wait_ms): a bucket of ``capacity`` tokens (twice the rate unless given), refilled by ``rate`` a second.

    An event that finds less than one token is denied, with the milliseconds until there is one. A rate of 0 or
    less lets all pass, as does an event without a key. A key's state goes when its bucket must be full again, which is
    how a key without state begins.
    """
    most = 2 * rate if capacity is None else capacity

    def step(name: object, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        at, event = row
        if rate <= 0 or name is None:
            return None, [(event, True, 0)]
        held = most if state is None else min(most, state[0] + (at - state[1]) * rate / 1000)
        if held >= 1:
            return (held - 1, at), [(event, True, 0)]
        return (held, at), [(event, False, int(-((held - 1) * 1000 // rate)))]

    return in_order(stream, key, [], step, "held double, last long", "event_id long, allowed boolean, wait_ms long", lambda s: s[1] + int(1000 * most / rate) + 1)
