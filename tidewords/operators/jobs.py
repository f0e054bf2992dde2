"""Queries over job records: filters, pages, positions and counts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewords.operators.patterns import first_k

STATUSES = ("queued", "running", "succeeded", "failed", "canceled", "expired")
TERMINAL = ("succeeded", "failed", "canceled", "expired")
BUSY = ("queued", "running")
HOUR, DAY = 3_600_000, 86_400_000


def filter_jobs(jobs: DataFrame, key: str | None, admin: bool = False, statuses: tuple[str, ...] = (), model: str | None = None, source: str | None = None, since: int | None = None) -> DataFrame:
    """The jobs that a caller sees; without a key these are the jobs that have none. An unknown status is an error."""
    if unknown := set(statuses) - set(STATUSES):
        raise ValueError(f"unknown status: {sorted(unknown)}")
    kept = jobs if admin else jobs.where(F.col("api_key_id").eqNullSafe(F.lit(key)))
    kept = kept.where(F.col("status").isin(*statuses)) if statuses else kept
    for column, value in (("model_id", model), ("source", source)):
        kept = kept.where(F.col(column) == value) if value else kept
    return kept if since is None else kept.where(F.col("created_ms") >= since)


def status_flags(status: Column) -> tuple[Column, Column]:
    """Whether a job has ended, and whether it holds a place in the queue or a worker."""
    return status.isin(*TERMINAL), status.isin(*BUSY)


def purge(jobs: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Jobs to remove: ended, and finished (or, never having started, created) longer than ``ttl`` ago; none if that is 0 or less."""
    return jobs.where(F.lit(ttl > 0) & status_flags(F.col("status"))[0] & (F.coalesce("finished_ms", "created_ms") < now - ttl))


def expire(rows: DataFrame, keep: Column, expires: Column, now: Column) -> DataFrame:
    """Rows to let go: neither kept nor busy, and past their time."""
    return rows.where(~keep & ~status_flags(F.col("status"))[1] & (expires < now))


def ranked(rows: DataFrame, cell: list[Column], within: list[Column]) -> DataFrame:
    """Rows with ``place`` from 1 in the order of ``cell`` and then ``within``.

    Only the counts of cells meet in one task; rows are ranked cell by cell.
    """
    names = [f"__cell{k}" for k in range(len(cell))]
    marked = rows.withColumns(dict(zip(names, cell, strict=True)))
    sizes = marked.groupBy(*names).agg(F.count("*").alias("__n"))
    ahead = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*names, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    inner = F.row_number().over(Window.partitionBy(*names).orderBy(*within))
    return marked.withColumn("__inner", inner).join(bases, names).withColumn("place", F.col("__base") + F.col("__inner")).drop(*names, "__base", "__inner")


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Queued jobs with their place: high priority first, then the oldest, then by id."""
    return ranked(jobs.where("status = 'queued'"), [-F.col("priority"), F.floor(F.col("created_ms") / HOUR)], [F.col("created_ms"), F.col("id")])


def concurrency(spans: DataFrame, key: str, limit: int, weight: str | None = None) -> DataFrame:
    """(key, at, level, over): how many spans (s, e) are open after each moment at which that changes.

    With ``weight`` their weights are summed instead; spans without an end stay open.

    Changes are summed per moment; running sums go day by day from the sums of earlier days, so that a hot key is
    spread over as many tasks as it has days.
    """
    by = F.col(weight) if weight else F.lit(1)
    moves = spans.select(key, F.col("s").alias("at"), by.alias("d")).unionByName(spans.where("e IS NOT NULL").select(key, F.col("e").alias("at"), (-by).alias("d")))
    moves = moves.groupBy(key, "at").agg(F.sum("d").alias("d")).withColumn("day", F.floor(F.col("at") / DAY))
    days = moves.groupBy(F.col(key).alias("__key"), F.col("day").alias("__day")).agg(F.sum("d").alias("d"))
    earlier = Window.partitionBy("__key").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("__key", "__day", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("base"))
    joined = moves.join(days, F.col(key).eqNullSafe(F.col("__key")) & (F.col("day") == F.col("__day")))
    level = F.col("base") + F.sum("d").over(Window.partitionBy(key, "day").orderBy("at"))
    return joined.withColumn("level", level).select(key, "at", "level", (F.col("level") > limit).alias("over"))


def running_totals(rows: DataFrame, at: str, values: list[str], cell: int = DAY) -> DataFrame:
    """Rows with each of ``values`` summed up to and with them in order of ``at``, cell by cell of time."""
    marked = rows.withColumn("__cell", F.floor(F.col(at) / cell))
    sums = marked.groupBy("__cell").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    ahead = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    bases = sums.select("__cell", *(F.coalesce(F.sum(f"__{v}").over(ahead), F.lit(0)).alias(f"__{v}") for v in values))
    inner = Window.partitionBy("__cell").orderBy(at)
    return marked.join(bases, "__cell").withColumns({v: F.col(f"__{v}") + F.sum(v).over(inner) for v in values}).drop("__cell", *(f"__{v}" for v in values))


def load_report(jobs: DataFrame, every: int = 60_000) -> DataFrame:
    """(minute_ms, submitted, failed, rejected, queued, running) of each stretch of time in which anything changed.

    Queued and running are the levels at its end. A job waits from creation to its start or, if it never starts,
    as long as it is queued; one that ended without a start counts as rejected when it was created.
    """
    zero = dict.fromkeys(("submitted", "failed", "rejected", "queued", "running"), F.lit(0))
    move = lambda at, **d: jobs.where(F.col(at).isNotNull()).select((F.floor(F.col(at) / every) * every).alias("minute_ms"), *(c.cast("long").alias(k) for k, c in (zero | d).items()))
    never = F.col("started_ms").isNull() & status_flags(F.col("status"))[0]
    moves = move("created_ms", submitted=F.lit(1), rejected=never.cast("int"), queued=(~never).cast("int"))
    moves = moves.unionByName(move("started_ms", queued=F.lit(-1), running=F.lit(1))).unionByName(move("finished_ms", running=F.lit(-1), failed=(F.col("status") == "failed").cast("int")))
    return running_totals(moves.groupBy("minute_ms").agg(*(F.sum(c).alias(c) for c in zero)), "minute_ms", ["queued", "running"])


def read_jobs(raw: DataFrame) -> DataFrame:
    """Job records from stored rows: times as timestamps, parameters parsed, an error only where there is a code."""
    params = F.from_json("params_json", "model string, language string, num_speakers int")
    error = F.when(F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"), F.coalesce("error_message", F.lit("")).alias("message")))
    times = {f"{c}_at": F.timestamp_millis(f"{c}_ms") for c in ("created", "started", "finished")}
    return raw.withColumn("params", params).withColumn("error", error).withColumns(times).drop("params_json", "error_code", "error_message", *(f"{c}_ms" for c in ("created", "started", "finished")))


#: Columns that a transition may change; all others stay as the job was created.
CHANGING = ("status", "model_id", "audio_ms", "started_ms", "finished_ms")


def apply_transitions(jobs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs after their transitions (a row an id), and the transitions of unknown jobs.

    All of ``CHANGING`` is taken from the transition, nulls too; jobs without one stay as they are.
    """
    u = updates.select(F.col("id"), F.struct(*CHANGING).alias("__u"))
    joined = jobs.join(u, "id", "left")
    new = joined.withColumns({c: F.when(F.col("__u").isNotNull(), F.col("__u")[c]).otherwise(F.col(c)) for c in CHANGING}).drop("__u")
    return new.select(*jobs.columns), updates.join(jobs.select("id"), "id", "left_anti")


def newest_first(rows: DataFrame, key: str | None, admin: bool = False) -> DataFrame:
    """What a caller owns, newest first and by id from the last; an admin sees all."""
    kept = rows if admin else rows.where(F.col("api_key_id").eqNullSafe(F.lit(key)))
    return kept.orderBy(F.desc("created_ms"), F.desc("id"))


def history_page(jobs: DataFrame, limit: int = 50, after: tuple[int, str] | None = None) -> DataFrame:
    """A page of jobs, newest first (id descending in ties), after a cursor; ``more`` tells that others follow."""
    limit = 50 if limit <= 0 else min(limit, 200)
    left = jobs if after is None else jobs.where((F.col("created_ms") < after[0]) | ((F.col("created_ms") == after[0]) & (F.col("id") < after[1])))
    page = left.orderBy(F.desc("created_ms"), F.desc("id")).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(F.desc("created_ms"), F.desc("id")))  # over one page only
    return page.withColumn("n", n).withColumn("more", F.max("n").over(Window.partitionBy()) > limit).where(F.col("n") <= limit)


def event_replay(events: DataFrame, job: str, order: list[Column], after: int = 0, kept: int = 16) -> DataFrame:
    """The last ``kept`` events of each job whose number is beyond ``after``."""
    numbered = events.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy(*order)))
    return first_k(numbered, [job], [F.desc("seq")], kept).where(F.col("seq") > after)


def latest_revision(models: DataFrame) -> DataFrame:
    """The highest revision of each model, and how many it has, by model."""
    return models.groupBy("model_id").agg(F.max("revision").alias("revision"), F.count("*").alias("revisions")).orderBy("model_id")
