"""Streaming operators over tables of several part files and several batches."""

import pytest
from pyspark.sql import functions as F

from tidewords import plans
from tidewords.streaming import events as op
from tidewords.streaming import utterances as ut
from tidewords.streaming.ordered import BUCKETS, in_order as in_order_of

DATA = "/root/testdata/sf0.001"
NAMES = ["t1_number_events", "t2_latest_job_state", "t3_stage_progress", "t4_token_bucket", "t5_idle_sessions", "t9_energy_stream", "t10_load_stream", "t11_level_stream", "t12_dedupe_events", "t14_job_table", "t6_segment_utterances", "t7_partials"]


@pytest.mark.parametrize("name", NAMES)
def test_events_in_parts(spark, tmp_path, name):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    assert len(list((tmp_path / "events.parquet").glob("part-*.parquet"))) == 5
    got, want = (sorted(map(repr, plans.QUERIES[name](spark, d).collect())) for d in (str(tmp_path), DATA))
    assert got == want and want


def in_order(spark, tmp_path):
    """Events in files by time, a batch each."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for n, (low, high) in enumerate(((0, 300), (300, 301), (301, 700), (700, 1000))):
        events.where(f"event_id >= {low} AND event_id < {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return op.event_stream(spark, str(tmp_path), files_a_batch=1)


CASES = {
    "number": lambda s: op.number_events(s, "user_id"),
    "bucket": lambda s: op.token_bucket(s, "user_id", 1 / 14400, 2.0).select("user_id", "event_id", "allowed"),
    "stage": lambda s: op.stage_progress(s.selectExpr("*", "'vad' AS stage"), "user_id", "stage"),
    "utterances": lambda s: ut.utterances(s.selectExpr("user_id", "event_id", "at", "at_ms", "event_type <> 'error' AS loud", "event_type AS word", "'' AS control"), "user_id", ut.Rules(14_400_000, 50_000_000, 20_000_000, 7_200_000, 3_600_000, 3_600_000, 3_600_000), 40 * 86_400_000),
    "sessions": lambda s: op.idle_sessions(s, "user_id", 7_200_000, 14_400_000),
}


@pytest.mark.parametrize("name", CASES)
def test_state_goes_on_from_batch_to_batch(spark, tmp_path, name):
    got, want = (sorted(map(repr, op.drained(CASES[name](s)).collect())) for s in (in_order(spark, tmp_path), op.event_stream(spark, DATA)))
    assert got == want and want


@pytest.mark.parametrize("name", CASES)
def test_rows_come_in_any_order_within_the_delay(spark, tmp_path, name):
    """Files of one batch each, from the last events to the first, and then one that moves the watermark past all of them."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for k in (3, 1, 4, 0, 2):
        events.where(f"event_id % 5 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    last = events.limit(1).selectExpr("-1L AS event_id", "ts + INTERVAL 400 DAYS AS ts", "-1L AS user_id", "event_type", "value", "props").select(*events.columns)
    last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    (tmp_path / "whole").mkdir()
    events.unionByName(last).coalesce(1).write.parquet(f"{tmp_path}/whole/events.parquet")
    parts = op.event_stream(spark, str(tmp_path), delay="200 days", files_a_batch=1)
    got, want = (sorted(map(repr, op.drained(CASES[name](s)).collect())) for s in (parts, op.event_stream(spark, f"{tmp_path}/whole", delay="200 days")))
    assert got == want and want


def test_steps_on_null_keys_and_texts(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "ts", "CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id", "CASE WHEN event_id % 3 > 0 THEN event_type END AS event_type", "value", "props")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = op.event_stream(spark, str(tmp_path))
    mark = events.selectExpr("max(unix_millis(cast(ts AS timestamp))) - 3600000").first()[0]
    allowed = op.drained(op.token_bucket(stream, "user_id", 1 / 14400, 2.0))
    n = events.where(f"unix_millis(cast(ts AS timestamp)) <= {mark}")
    assert allowed.count() == n.count() and allowed.where("user_id IS NULL AND NOT allowed").count() == 0
    numbered = op.drained(op.number_events(stream, "user_id", terminal="none"))
    assert numbered.where("user_id IS NULL").agg({"seq": "max"}).first()[0] == n.where("user_id IS NULL").count()


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.glob("data/*/bucket=*/part-*")}


def test_job_table_over_batches(spark, tmp_path):
    parts, table = in_order(spark, tmp_path).select("user_id", "event_id", "event_type", "at_ms"), f"{tmp_path}/jobs"
    assert op.read_job_table(spark, table) is None
    op.job_table(parts, table, "user_id")
    want = {r.user_id: r.event_id for r in plans.QUERIES["t2_latest_job_state"](spark, DATA).collect()}
    assert {r.user_id: r.event_id for r in op.read_job_table(spark, table).collect()} == want
    assert op.read_job_table(spark, table, 2).count() <= len(want) and op.read_job_table(spark, table, 0) is None


def transitions(spark, listed):
    return spark.createDataFrame(listed, "job string, event_id long, status string, at_ms long")


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    table = str(tmp_path / "t")
    op.apply_batch(transitions(spark, [(f"j{k}", k, "queued", k) for k in range(300)]), 0, table, "job", buckets=16)
    first = files_of(tmp_path / "t")
    assert len(first) == 16
    op.apply_batch(transitions(spark, [("j7", 400, "running", 400), ("j7", 399, "queued", 399), ("j5", 1, "late", 1)]), 1, table, "job", buckets=16)
    second = files_of(tmp_path / "t")
    new = [f for f in second if f not in first]
    assert len(new) <= 2 and all(second[f] == at for f, at in first.items())  # the folders of the version before stay
    op.apply_batch(transitions(spark, [("x", 500, "queued", 500)]), 2, table, "job", buckets=16)
    assert len(files_of(tmp_path / "t")) == 16 + 1  # what no version reads is gone
    rows = {r.job: (r.status, r.event_id) for r in op.read_job_table(spark, table).collect()}
    assert len(rows) == 301 and rows["j7"] == ("running", 400) and rows["j5"] == ("queued", 5) and rows["x"] == ("queued", 500)


def test_a_failed_batch_leaves_the_table_and_a_replay_mends_it(spark, tmp_path):
    table = str(tmp_path / "t")
    op.apply_batch(transitions(spark, [("a", 1, "queued", 1)]), 0, table, "job", buckets=4)
    op.apply_batch(transitions(spark, [("a", 2, "running", 2), ("b", 3, "queued", 3)]), 1, table, "job", buckets=4)
    before = sorted(map(tuple, op.read_job_table(spark, table).collect()))
    (tmp_path / "t" / "manifest" / "1" / "_SUCCESS").unlink()  # as if the batch had died before its manifest was whole
    assert sorted(r.status for r in op.read_job_table(spark, table).collect()) == ["queued"]
    for _ in range(2):
        op.apply_batch(transitions(spark, [("a", 2, "running", 2), ("b", 3, "queued", 3)]), 1, table, "job", buckets=4)
        assert sorted(map(tuple, op.read_job_table(spark, table).collect())) == before
    op.apply_batch(transitions(spark, []), 2, table, "job", buckets=4)
    assert sorted(map(tuple, op.read_job_table(spark, table).collect())) == before


def heard(rules, listed):
    """What is told of (at, word or None for quiet or a control) rows."""
    now, told = ut.Item(0, 0, 0, -rules.interval), []
    for at, what in listed:
        control = what if what in ("commit", "clear") else ""
        told += ut.hear(now, rules, at, bool(what) and not control, what if what and not control else "", control)
    return told


def test_utterances_end_by_silence_length_pause_and_commit():
    rules = ut.Rules()
    finals = lambda listed: [(t[2], t[3], t[4], t[6]) for t in heard(rules, listed) if t[1] == "final"]
    assert finals([(100, "a"), (200, "b"), (1300, None), (1400, None)]) == [(0, 1400, "a b", "silence")]
    assert finals([(k * 100, "x") for k in range(1, 201)])[0][1:2] + finals([(k * 100, "x") for k in range(1, 201)])[0][3:] == (20_000, "max_length")
    assert finals([(k * 100, "x") for k in range(1, 160)] + [(16_000, None), (16_200, None)])[0][3] == "pause"
    assert finals([(100, "commit"), (200, "a"), (300, "commit")]) == [(0, 100, "", "commit"), (100, 300, "a", "commit")]
    assert finals([(100, "a"), (200, "clear"), (1500, None), (3000, None), (3100, "b"), (3200, "commit")]) == [(2300, 3200, "b", "commit")]


def test_partials_keep_their_interval_and_add_up():
    told = [t for t in heard(ut.Rules(), [(100, "a"), (200, "b"), (350, "c"), (450, "d")]) if t[1] == "partial"]
    assert [(t[4], t[5]) for t in told] == [("a", "a"), ("a b c d", " b c d")]


def test_every_event_gets_a_token_or_none(spark):
    """The events of the stream's last hour are decided too."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert plans.QUERIES["t4_token_bucket"](spark, "/root/testdata/sf0.001").count() == events.count()


def many_keys(spark, tmp_path, users):
    """Three events a user, a minute apart, some of nobody, and one of user -1 that is so late that the watermark passes all others."""
    made = spark.range(3 * users).selectExpr("id AS event_id", f"timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id div {users}) AS ts", f"CASE WHEN id % {users} > 0 THEN id % {users} END AS user_id", "'view' AS event_type", "1D AS value", "'' AS props")
    last = made.limit(1).selectExpr("-1L AS event_id", "ts + INTERVAL 2 DAYS AS ts", "-1L AS user_id", "event_type", "value", "props")
    made.unionByName(last).coalesce(2).write.parquet(f"{tmp_path}/events.parquet")
    return op.event_stream(spark, str(tmp_path))


def test_many_keys_share_a_bucket_of_the_state(spark, tmp_path):
    """A call of Python and a row of the state are a bucket's, not a key's."""
    users = 3 * BUCKETS
    told = op.number_events(many_keys(spark, tmp_path, users), "user_id")
    run = told.writeStream.format("memory").queryName("many_keys").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    held = [s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]]
    assert held and 0 < max(held) <= BUCKETS
    n = spark.table("many_keys").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "seq"))).alias("s")).collect()
    assert len(n) == users and all([tuple(x) for x in r.s] == [((r.user_id or 0) + k * users, k + 1) for k in range(3)] for r in n)


@pytest.mark.parametrize("buckets", [1, 7])
def test_keys_of_a_bucket_keep_apart(spark, tmp_path, buckets):
    """A state that ends and goes, and told rows of nobody, whatever shares the bucket."""
    stream = many_keys(spark, tmp_path, 50)
    step = lambda name, state, row: ((1 + (state[0] if state else 0), row[0]), [(row[1], name or "none")])
    told = in_order_of(stream, "user_id", ["event_type"], step, "n long, at long", "event_id long, name string", lambda s: s[1] + 60_000, lambda name, s: [(-s[0], name or "none")], buckets)
    got = sorted((str(r.user_id), r.event_id, r.name) for r in op.drained(told).collect())
    names = [(str(k or None), str(k or "none"), k) for k in range(50)]
    assert got == sorted([(u, k + 50 * i, name) for u, name, k in names for i in range(3)] + [(u, -3, name) for u, name, _ in names])
