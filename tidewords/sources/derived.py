"""Transcript tables derived from the driver's tables, as DataFrames and as DuckDB common table expressions.

Times are whole milliseconds and confidences whole thousandths (0: unknown), so that engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SENTENCE_END = (".", "!", "?")


#: Bytes of text whose words one task takes; the words are some thirty times as large in memory.
TASK_BYTES = 1 << 19


def dealt(turns: DataFrame, key: str) -> DataFrame:
    """Turns dealt by recording before their words are cut, into tasks of about ``TASK_BYTES`` of text.

    Windows, groups and unions by recording need no other exchange, and a task doesn't grow with the table.
    """
    told = turns.agg(F.sum(F.octet_length("text")).alias("n")).first()
    return turns.repartition(1 + (told.n or 0) // TASK_BYTES, key)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, turn, pos, wid, role, channel, word, start_ms, end_ms, conf_milli of the conversations, dealt by recording."""
    turns = dealt(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id").withColumn("ws", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    order = Window.partitionBy("rec_id").orderBy("turn", "pos")
    length, assistant = F.length("word"), F.when(F.col("role") == "assistant", 1).otherwise(0)
    ended = F.substring("word", -1, 1).isin(*SENTENCE_END)
    back = F.col("gap") + 600 * assistant
    return (
        turns.select(F.col("conv_id").alias("rec_id"), "turn", "role", F.posexplode("ws").alias("pos", "word"))
        .withColumn("dur", (80 + 40 * length).cast("long"))
        .withColumn("gap", (20 + 10 * (length % 4) + F.when(ended, 400).otherwise(0)).cast("long"))
        .withColumn("e", F.sum(F.col("dur") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select(
            "rec_id", "turn", "pos", (F.row_number().over(order) - 1).alias("wid"), "role", assistant.alias("channel"), "word",
            F.greatest(F.col("e") - F.col("dur") - back, F.lit(0)).alias("start_ms"), F.greatest(F.col("e") - back, F.lit(1)).alias("end_ms"),
            F.when(length % 11 == 0, 0).otherwise(300 + 70 * (length % 10)).alias("conf_milli"),
        )
    )


def segments(words: DataFrame) -> DataFrame:
    """One row a sentence of a turn: rec_id, turn, channel, role, sn, start_ms, end_ms, n_words, conf_milli, text."""
    before = Window.partitionBy("rec_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.when(F.substring("word", -1, 1).isin(*SENTENCE_END), 1).otherwise(0)
    parts = words.withColumn("sn", F.coalesce(F.sum(ended).over(before), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return parts.groupBy("rec_id", "turn", "channel", "role", "sn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"), text.alias("text"))


def turns(words: DataFrame, jitter: bool = True) -> DataFrame:
    """A diarizer's turns: rec_id, turn_ord, speaker, start_ms, end_ms; the reference turns without jitter."""
    first = F.min("t0").over(Window.partitionBy("rec_id", "role"))
    by_turn = words.groupBy("rec_id", "turn", "role").agg(F.min("start_ms").alias("st"), F.max("end_ms").alias("en"), F.min("turn").alias("t0")).withColumn("f", first)
    move = lambda k: ((F.col("turn") * k) % 5 - 2) * (60 if jitter else 0)
    speaker = (F.dense_rank().over(Window.partitionBy("rec_id").orderBy("f")) - 1).cast("int")
    return by_turn.select("rec_id", F.col("turn").alias("turn_ord"), speaker.alias("speaker"), F.greatest(F.col("st") + move(37), F.lit(0)).alias("start_ms"), (F.col("en") + move(53)).alias("end_ms"))


def tokens(words: DataFrame) -> DataFrame:
    """Words cut into three-character pieces, the first with the word mark: rec_id, turn, wid, k, token, ts_ms."""
    pieces = words.select("rec_id", "turn", "wid", "word", "start_ms", "end_ms", "conf_milli", F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / 3).cast("int"))).alias("k"))
    piece = F.expr("substring(word, 3 * k + 1, 3)")
    return pieces.select("rec_id", "turn", "wid", "k", F.when(F.col("k") == 0, F.concat(F.lit("▁"), piece)).otherwise(piece).alias("token"), (F.col("start_ms") + 60 * F.col("k")).alias("ts_ms"), "end_ms", "conf_milli")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows from the events; creation times are cut to the minute, so that they tie."""
    kind = F.create_map(*(F.lit(x) for p in (("signup", "queued"), ("view", "running"), ("purchase", "succeeded"), ("error", "failed")) for x in p))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.concat(F.lit("job_"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("id"),
        F.coalesce(kind[F.col("event_type")], F.when(F.col("event_id") % 2 == 0, "canceled").otherwise("expired")).alias("status"),
        F.when(F.col("user_id") % 10 == 0, 10).otherwise(0).alias("priority"),
        F.concat(F.lit("m"), F.col("user_id") % 5).alias("model_id"),
        F.when(F.col("user_id") % 8 != 7, F.concat(F.lit("key_"), F.col("user_id") % 8)).alias("api_key_id"),
        F.when(F.col("event_id") % 3 == 0, "ui").otherwise("api").alias("source"),
        F.expr("unix_millis(to_utc_timestamp(cast(ts as timestamp), current_timezone())) div 60000 * 60000").alias("created_ms"),
        F.expr("cast(round(value * 1000) as bigint)").alias("audio_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "user_id",
    ).withColumns(
        {
            "started_ms": F.when(F.col("status").isin("running", "succeeded", "failed"), F.col("created_ms") + 20_000 * (F.col("k") % 7)),
            "finished_ms": F.when(F.col("status").isin("succeeded", "failed"), F.col("created_ms") + 20_000 * (F.col("k") % 7) + F.col("audio_ms")),
        }
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a signal of 64 values: rec_id, idx, v, label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("rec_id"), "label", F.posexplode("embedding").alias("idx", "x")).select("rec_id", "label", "idx", F.col("x").cast("double").alias("v"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary a source: dict_key, ord, phrase (each three words in a row of each of its documents)."""
    ws = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", ws.alias("ws")).where(F.size("ws") > 0)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 3).cast("int")), lambda k: F.concat_ws(" ", F.slice("ws", 3 * k + 1, F.lit(3))))
    return docs.select(F.col("source").alias("dict_key"), "doc_id", F.posexplode(runs).alias("k", "phrase")).select("dict_key", (F.col("doc_id") * 1_000_000_000 + F.col("k")).alias("ord"), "phrase")


def dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary a document: dict_key, ord, phrase (its lines, as they are)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("dict_key"), F.posexplode(F.split("text", "\n")).alias("ord", "phrase"))


def spoken(words: DataFrame) -> DataFrame:
    """Segments as a transcript has them: rec_id, id, channel, speaker (null for the system's), times, text, words, mean confidence.

    Words that are dealt by recording need no exchange for the sentences, their sums and their numbers.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    conf = F.coalesce(F.avg(F.when(F.col("conf_milli") > 0, F.col("conf_milli"))), F.lit(0.0))
    s = words.withColumn("sn", _sentence()).groupBy("rec_id", "turn", "channel", "role", "sn")
    s = s.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_words"), text.alias("text"), conf.alias("conf"))
    order = Window.partitionBy("rec_id").orderBy("start_ms", "channel", "turn", "sn")
    return s.select("rec_id", (F.row_number().over(order) - 1).alias("id"), "turn", "sn", "channel", speaker_of("role").alias("speaker"), "start_ms", "end_ms", "text", "n_words", (F.col("conf") / 1000).alias("avg_conf"))


def spoken_words(words: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Words with the number and speaker of their segment among those of ``spoken``, in the transcript's order (seq)."""
    own, of = Window.partitionBy("rec_id", "turn", "sn"), Window.partitionBy("rec_id")
    w = words.withColumn("sn", _sentence()).withColumn("began", F.min("start_ms").over(own))
    w = w.withColumn("id", F.dense_rank().over(of.orderBy("began", "channel", "turn", "sn")) - 1)
    return w.select("rec_id", "id", (F.row_number().over(of.orderBy("id", "pos")) - 1).alias("seq"), "wid", "pos", "channel", speaker_of("role").alias("speaker"), "word", "start_ms", "end_ms", "conf_milli")


def speaker_of(role: str) -> Column:
    return F.when(F.col(role) == "user", "spk_0").when(F.col(role) == "assistant", "spk_1")


def _sentence() -> Column:
    ended = F.when(F.substring("word", -1, 1).isin(*SENTENCE_END), 1).otherwise(0)
    return F.coalesce(F.sum(ended).over(Window.partitionBy("rec_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


WORDS_SQL = r"""
tok AS (SELECT conv_id, turn, role, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word
  FROM (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM conversations)),
words AS (SELECT conv_id AS rec_id, turn, pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS wid, role,
  CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS channel, word,
  greatest(e - dur - gap - CASE WHEN role = 'assistant' THEN 600 ELSE 0 END, 0) AS start_ms,
  greatest(e - gap - CASE WHEN role = 'assistant' THEN 600 ELSE 0 END, 1) AS end_ms,
  CASE WHEN length(word) % 11 = 0 THEN 0 ELSE 300 + 70 * (length(word) % 10) END AS conf_milli
FROM (SELECT *, CAST(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e
  FROM (SELECT *, CAST(80 + 40 * length(word) AS BIGINT) AS dur,
    CAST(20 + 10 * (length(word) % 4) + CASE WHEN right(word, 1) IN ('.', '!', '?') THEN 400 ELSE 0 END AS BIGINT) AS gap FROM tok) t) u)"""
SEGMENTS_SQL = (
    WORDS_SQL
    + """,
segments AS (SELECT rec_id, turn, channel, role, CAST(sn AS BIGINT) AS sn, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY pos) AS text
  FROM (SELECT *, coalesce(sum(CASE WHEN right(word, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sn FROM words) x
  GROUP BY rec_id, turn, channel, role, sn)"""
)
TURNS_SQL = (
    WORDS_SQL
    + """,
reference AS (SELECT rec_id, turn AS turn_ord, dense_rank() OVER (PARTITION BY rec_id ORDER BY f) - 1 AS speaker, st AS start_ms, en AS end_ms
  FROM (SELECT rec_id, turn, role, min(start_ms) AS st, max(end_ms) AS en, min(min(turn)) OVER (PARTITION BY rec_id, role) AS f FROM words GROUP BY rec_id, turn, role) z),
turns AS (SELECT rec_id, turn_ord, speaker, greatest(start_ms + ((turn_ord * 37) % 5 - 2) * 60, 0) AS start_ms, end_ms + ((turn_ord * 53) % 5 - 2) * 60 AS end_ms FROM reference)"""
)
TOKENS_SQL = (
    WORDS_SQL
    + """,
tokens AS (SELECT rec_id, turn, wid, k, CASE WHEN k = 0 THEN '▁' ELSE '' END || substr(word, 3 * k + 1, 3) AS token, start_ms + 60 * k AS ts_ms, end_ms, conf_milli
  FROM (SELECT *, unnest(range(0, (length(word) - 1) // 3 + 1)) AS k FROM words))"""
)
JOBS_SQL = """
base_jobs AS (SELECT concat('job_', lpad(CAST(event_id AS VARCHAR), 8, '0')) AS id,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE CASE WHEN event_id % 2 = 0 THEN 'canceled' ELSE 'expired' END END AS status,
  CASE WHEN user_id % 10 = 0 THEN 10 ELSE 0 END AS priority, concat('m', CAST(user_id % 5 AS VARCHAR)) AS model_id,
  CASE WHEN user_id % 8 = 7 THEN NULL ELSE concat('key_', CAST(user_id % 8 AS VARCHAR)) END AS api_key_id,
  CASE WHEN event_id % 3 = 0 THEN 'ui' ELSE 'api' END AS source, (epoch_us(ts) // 60000000) * 60000 AS created_ms,
  CAST(round(value * 1000) AS BIGINT) AS audio_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id FROM events),
jobs AS (SELECT *, CASE WHEN status IN ('running', 'succeeded', 'failed') THEN created_ms + 20000 * (k % 7) END AS started_ms,
  CASE WHEN status IN ('succeeded', 'failed') THEN created_ms + 20000 * (k % 7) + audio_ms END AS finished_ms FROM base_jobs)"""
SAMPLES_SQL = """
samples AS (SELECT vec_id AS rec_id, label, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""
PHRASES_SQL = r"""
cutdocs AS (SELECT source, doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
phrases AS (SELECT source AS dict_key, doc_id * 1000000000 + k AS ord, array_to_string(ws[3 * k + 1:3 * k + 3], ' ') AS phrase
  FROM (SELECT *, unnest(range(0, (len(ws) - 1) // 3 + 1)) AS k FROM cutdocs WHERE len(ws) > 0))"""
DICTIONARIES_SQL = """
lines AS (SELECT 'doc_' || doc_id AS dict_key, generate_subscripts(ls, 1) - 1 AS ord, unnest(ls) AS phrase FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""
SPOKEN_SQL = (
    SEGMENTS_SQL
    + """,
numbered AS (SELECT *, coalesce(sum(CASE WHEN right(word, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sn FROM words),
confs AS (SELECT rec_id, turn, sn, coalesce(avg(nullif(conf_milli, 0)), 0) / 1000 AS avg_conf FROM numbered GROUP BY ALL),
spoken AS (SELECT s.rec_id, row_number() OVER (PARTITION BY s.rec_id ORDER BY start_ms, channel, s.turn, s.sn) - 1 AS id, s.turn, s.sn, channel, CASE role WHEN 'user' THEN 'spk_0' WHEN 'assistant' THEN 'spk_1' END AS speaker, start_ms, end_ms, text, n_words, avg_conf
  FROM segments s JOIN confs c ON c.rec_id = s.rec_id AND c.turn = s.turn AND c.sn = s.sn),
said AS (SELECT n.rec_id, p.id, row_number() OVER (PARTITION BY n.rec_id ORDER BY p.id, n.pos) - 1 AS seq, n.wid, n.pos, n.channel, p.speaker, n.word, n.start_ms, n.end_ms, n.conf_milli FROM numbered n JOIN spoken p ON p.rec_id = n.rec_id AND p.turn = n.turn AND p.sn = n.sn)"""
)
