"""Streaming queries, each run over all events; their SQL is that of the batch that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewords.plans.registry import query
from tidewords.sources import derived as d
from tidewords.sources.shared import settle, shared_folder
from tidewords.streaming import events as op
from tidewords.streaming import utterances as ut

#: A token each four hours, two at most: events of a user are hours apart.
RATE, CAPACITY = 1 / 14400, 2.0
#: What the watermark, an hour behind the last event, has passed.
_MARK = "(SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)"
#: The events that steps in order have taken when the stream has been read.
_PASSED = f"passed AS (SELECT * FROM events WHERE epoch_us(ts) // 1000 <= {_MARK})"


@query(
    "t1_number_events",
    f"""WITH {_PASSED}, t AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS topic FROM passed),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY ts, event_id) AS seq FROM t) SELECT user_id, event_id, seq FROM n WHERE NOT (event_type = 'error' AND seq = 1)""",
)
def _(spark, sf_dir):
    return op.drained(op.number_events(op.event_stream(spark, sf_dir), "user_id"))


@query("t2_latest_job_state", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return op.drained(op.latest_state(op.event_stream(spark, sf_dir), "user_id"), ["user_id"])


@query(
    "t4_token_bucket",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, t, i, true AS allowed, {CAPACITY}::DOUBLE AS full, {CAPACITY - 1}::DOUBLE AS held FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, least({CAPACITY}::DOUBLE, w.held + (e.t - w.t) * {RATE!r}::DOUBLE / 1000) >= 1, least({CAPACITY}::DOUBLE, w.held + (e.t - w.t) * {RATE!r}::DOUBLE / 1000),
    CASE WHEN least({CAPACITY}::DOUBLE, w.held + (e.t - w.t) * {RATE!r}::DOUBLE / 1000) >= 1 THEN least({CAPACITY}::DOUBLE, w.held + (e.t - w.t) * {RATE!r}::DOUBLE / 1000) - 1 ELSE least({CAPACITY}::DOUBLE, w.held + (e.t - w.t) * {RATE!r}::DOUBLE / 1000) END
  FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, event_id, allowed FROM w""",
)
def _(spark, sf_dir):
    closing = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
    told = op.token_bucket(op.event_stream(spark, sf_dir, closing=closing), "user_id", RATE, CAPACITY)
    return op.drained(told, end=lambda: op.close(spark, sf_dir, closing)).select("user_id", "event_id", "allowed")


_SESSIONS = f"""WITH RECURSIVE {_PASSED}, e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM passed),
w AS (SELECT user_id, t, i, t AS start, 1 AS n, 0 AS k, CAST(NULL AS VARCHAR) AS why FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.t, e.i, CASE WHEN e.t - w.t > 7200000 OR e.t - w.start >= 14400000 THEN e.t ELSE w.start END, CASE WHEN e.t - w.t > 7200000 OR e.t - w.start >= 14400000 THEN 1 ELSE w.n + 1 END,
    CASE WHEN e.t - w.t > 7200000 OR e.t - w.start >= 14400000 THEN w.k + 1 ELSE w.k END, CASE WHEN e.t - w.t > 7200000 THEN 'idle' WHEN e.t - w.start >= 14400000 THEN 'length' END
  FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1),
s AS (SELECT user_id, k, max(start) AS start_ms, max(t) AS last_ms, max(n) AS n FROM w GROUP BY user_id, k)"""


@query("t5_idle_sessions", f"{_SESSIONS} SELECT s.user_id, start_ms, last_ms, CAST(n AS BIGINT) AS n, coalesce((SELECT any_value(why) FROM w WHERE w.user_id = s.user_id AND w.k = s.k + 1 AND w.n = 1), 'idle') AS reason FROM s WHERE EXISTS (SELECT 1 FROM s x WHERE x.user_id = s.user_id AND x.k = s.k + 1) OR last_ms + 7200000 < {_MARK}")
def _(spark, sf_dir):
    return op.drained(op.idle_sessions(op.event_stream(spark, sf_dir), "user_id", 7_200_000, 14_400_000))


@query("t9_energy_stream", f"SELECT epoch_us(ts) // 10000 * 10 AS start_ms, count(*) AS n, round(sum(value * value), 4) AS energy FROM events GROUP BY 1 HAVING epoch_us(min(ts)) // 10000 * 10 + 10 <= {_MARK}")
def _(spark, sf_dir):
    return op.drained(op.energy(op.event_stream(spark, sf_dir))).withColumn("energy", F.round(F.col("power") * F.col("n"), 4)).drop("power")


@query("t10_load_stream", f"SELECT epoch_us(ts) // 60000000 * 60000 AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING epoch_us(min(ts)) // 60000000 * 60000 + 60000 <= {_MARK}")
def _(spark, sf_dir):
    return op.drained(op.load(op.event_stream(spark, sf_dir)))


#: Levels in steps of half a decibel, blocks of ten minutes, windows of six hours: an exact percentile, put on its step.
@query(
    "t11_level_stream",
    f"""WITH b AS (SELECT epoch_us(ts) // 600000000 AS b, avg(value * value) AS power FROM events GROUP BY 1 HAVING (epoch_us(min(ts)) // 600000000 + 1) * 600000 <= {_MARK}),
w AS (SELECT power, CAST(floor(10 * log10(power + 1e-12) / 0.5) AS INT) AS step, (b // 6 - k) * 3600000 AS start_ms FROM b, range(6) r(k)),
l AS (SELECT start_ms, count(*) AS n, max(power) AS loudest, list(step ORDER BY step) AS s FROM w GROUP BY start_ms)
SELECT start_ms, n, round(loudest, 6) AS loudest, s[CAST(floor((n - 1) * 0.95) AS BIGINT) + 1] * 0.5::DOUBLE AS level_db FROM l WHERE start_ms + 21600000 <= {_MARK}""",
)
def _(spark, sf_dir):
    told = op.level(op.event_stream(spark, sf_dir), "6 hours", "1 hour", "10 minutes")
    return op.drained(told).withColumn("loudest", F.round("loudest", 6))


_STAGE = "['decode', 'vad', 'asr', 'assemble', 'post'][CAST(event_id % 5 AS INT) + 1]"


@query("t3_stage_progress", f"WITH {_PASSED}, h AS (SELECT *, last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS status FROM passed) SELECT user_id, event_id, {_STAGE} AS stage, CASE {_STAGE} WHEN 'decode' THEN 10 WHEN 'vad' THEN 25 WHEN 'asr' THEN 40 WHEN 'assemble' THEN 95 ELSE 0 END AS percent FROM h WHERE event_type = 'click' AND status = 'view'")
def _(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, ("decode", "vad", "asr", "assemble", "post"))), (F.col("event_id") % 5 + 1).cast("int"))
    return op.drained(op.stage_progress(op.event_stream(spark, sf_dir).withColumn("stage", stage), "user_id", "stage"))


@query("t14_job_table", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(spark, sf_dir):
    table = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    op.job_table(op.event_stream(spark, sf_dir).select("user_id", "event_id", "event_type", "at_ms"), table, "user_id")
    return op.read_job_table(spark, table).select("user_id", "event_id", "event_type")


#: A user's events as a live stream, hours in place of seconds: some are sounds with a word, some quiet, some controls.
_HOUR = 3_600_000
_RULES = ut.Rules(silence=6 * _HOUR, limit=30 * _HOUR, search=0, guard=2 * _HOUR, interval=0)
_HEARD = f"""WITH RECURSIVE {_PASSED}, e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_type IN ('view', 'click') AS loud, 'w' || event_id AS word, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM passed),
w0 AS (SELECT user_id, t, i, 0 AS item, t AS start, t AS heard, CASE WHEN loud THEN word ELSE '' END AS said FROM e WHERE i = 1),
w AS (SELECT user_id, t, i, item, start, heard, said, start AS was, '' AS final, '' AS cut FROM w0
  UNION ALL SELECT user_id, t, i, CASE WHEN ends <> '' THEN item + 1 ELSE item END, CASE WHEN ends <> '' THEN t WHEN quiet >= {6 * _HOUR} THEN greatest(start, t - {2 * _HOUR}) ELSE start END, CASE WHEN ends <> '' THEN t ELSE heard END, CASE WHEN ends <> '' THEN '' ELSE said END, start, CASE WHEN ends <> '' THEN said ELSE '' END, ends
  FROM (SELECT *, CASE WHEN t - start >= {30 * _HOUR} THEN 'max_length' WHEN quiet >= {6 * _HOUR} AND said <> '' THEN 'silence' ELSE '' END AS ends
    FROM (SELECT e.user_id, e.t, e.i, w.item, w.start, CASE WHEN e.loud THEN e.t ELSE w.heard END AS heard, CASE WHEN e.loud THEN trim(w.said || ' ' || e.word) ELSE w.said END AS said, e.t - CASE WHEN e.loud THEN e.t ELSE w.heard END AS quiet FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)))"""


def _live(spark, sf_dir):
    stream, kind = op.event_stream(spark, sf_dir), F.col("event_type")
    loud = kind.isin("view", "click")
    return stream.select("user_id", "event_id", "at", "at_ms", "event_type", loud.alias("loud"), F.when(loud, F.concat(F.lit("w"), F.col("event_id").cast("string"))).otherwise("").alias("word"), F.lit("").alias("control"))


@query("t6_segment_utterances", f"{_HEARD} SELECT user_id, CAST(item - 1 AS BIGINT) AS item, was AS start_ms, t AS end_ms, final AS text, cut FROM w WHERE final <> ''")
def _(spark, sf_dir):
    return op.drained(ut.utterances(_live(spark, sf_dir), "user_id", _RULES, 90 * 24 * _HOUR)).where("kind = 'final'").select("user_id", "item", "start_ms", "end_ms", "text", "cut")


#: The same with pauses looked for, partials three hours apart at least, commits and clears: a step a row, which may tell up to three things.
_TOLD = f"""WITH RECURSIVE {_PASSED}, e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_type IN ('view', 'click') AS loud, 'w' || event_id AS word,
  CASE WHEN event_type = 'signup' THEN 'commit' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'clear' ELSE '' END AS control, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM passed),
w AS (SELECT user_id, t, 0::BIGINT AS i, 0 AS item, t AS start, t AS heard, t - {3 * _HOUR} AS told_at, '' AS said, '' AS told, 0 AS was, t AS began, false AS opened, NULL::VARCHAR AS partial, '' AS delta, '' AS text, '' AS cut FROM e WHERE i = 1
  UNION ALL SELECT user_id, t, i, CASE WHEN cut <> '' THEN item + 1 ELSE item END, CASE WHEN cut <> '' THEN t WHEN quiet >= {6 * _HOUR} AND said1 = '' THEN greatest(start, t - {2 * _HOUR}) ELSE start END, CASE WHEN cut <> '' THEN t ELSE heard1 END,
    CASE WHEN partial THEN t ELSE told_at END, CASE WHEN cut <> '' THEN '' ELSE said1 END, CASE WHEN cut <> '' THEN '' WHEN partial THEN said1 ELSE told END, item, start, opened, CASE WHEN partial THEN said1 END,
    CASE WHEN NOT partial THEN '' WHEN told = '' THEN said1 WHEN starts_with(said1, told) THEN substr(said1, length(told) + 1) ELSE '' END, said1, cut
  FROM (SELECT *, CASE WHEN control = 'clear' THEN 'clear' WHEN control = 'commit' THEN 'commit' WHEN t - start >= {30 * _HOUR} THEN 'max_length'
      WHEN t - start - {20 * _HOUR} >= 0 AND said1 <> '' AND quiet >= {4 * _HOUR} - least((t - start - {20 * _HOUR}) / {10.0 * _HOUR}::DOUBLE, 1) * {3 * _HOUR} THEN 'pause' WHEN quiet >= {6 * _HOUR} AND said1 <> '' THEN 'silence' ELSE '' END AS cut
    FROM (SELECT *, t - heard1 AS quiet, loud AND said = '' AS opened, loud AND said1 <> told AND t - told_at >= {3 * _HOUR} AS partial
      FROM (SELECT w.user_id, e.t, e.i, w.item, w.start, w.told_at, w.said, w.told, e.loud, e.control, CASE WHEN e.loud THEN e.t ELSE w.heard END AS heard1, CASE WHEN e.loud THEN trim(w.said || ' ' || e.word) ELSE w.said END AS said1
        FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)))),
steps AS (SELECT user_id, CAST(was AS BIGINT) AS item, began AS start_ms, t AS end_ms, opened, partial, delta, text, cut FROM w WHERE i > 0)"""


@query(
    "t7_partials",
    _TOLD
    + """ SELECT user_id, item, 'speech_started' AS kind, start_ms, end_ms, '' AS text, '' AS delta, '' AS cut FROM steps WHERE opened
UNION ALL SELECT user_id, item, 'partial', start_ms, end_ms, partial, delta, '' FROM steps WHERE partial IS NOT NULL
UNION ALL SELECT user_id, item, 'cleared', start_ms, end_ms, '', '', '' FROM steps WHERE cut = 'clear'
UNION ALL SELECT user_id, item, 'final', start_ms, end_ms, text, '', cut FROM steps WHERE cut NOT IN ('', 'clear') AND (text <> '' OR cut = 'commit')""",
)
def _(spark, sf_dir):
    rules = ut.Rules(silence=6 * _HOUR, limit=30 * _HOUR, search=10 * _HOUR, pause=4 * _HOUR, dip=_HOUR, guard=2 * _HOUR, interval=3 * _HOUR)
    control = F.when(F.col("event_type") == "signup", "commit").when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), "clear").otherwise("")
    return op.drained(ut.utterances(_live(spark, sf_dir).withColumn("control", control), "user_id", rules, 90 * 24 * _HOUR))


@query("t15_utterance_words", f"WITH {d.SPOKEN_SQL} SELECT s.rec_id, s.seq, greatest(s.start_ms - 120, p.start_ms) AS start_ms, greatest(s.end_ms - 120, s.start_ms - 120, p.start_ms) AS end_ms FROM said s JOIN spoken p USING (rec_id, id)")
def _(spark, sf_dir):
    w = d.words(spark, sf_dir)
    s = d.spoken(w)
    item = s.select("rec_id", "id", F.col("start_ms").alias("item_start_ms"), (F.col("start_ms") - 620).alias("clock_ms"))
    heard = d.spoken_words(w, s).join(item, ["rec_id", "id"])
    own = heard.withColumns({c: F.col(c) - F.col("item_start_ms") + 500 for c in ("start_ms", "end_ms")})
    return ut.utterance_words(own).select("rec_id", "seq", "start_ms", "end_ms")


@query("t12_dedupe_events", "SELECT user_id, event_id FROM events")
def _(spark, sf_dir):
    stream = op.event_stream(spark, sf_dir)
    twice = stream.unionByName(stream.where("event_id % 3 = 0"))
    return op.drained(op.once(twice, ["user_id", "event_id"]).select("user_id", "event_id"))
