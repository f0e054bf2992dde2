"""Queries over jobs and phrase dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewords.functions.scalar import valid_key
from tidewords.operators import dictionaries as dic
from tidewords.operators import jobs as op
from tidewords.plans.registry import query
from tidewords.sources import derived as d

_JOBS = f"WITH {d.JOBS_SQL}"
_PHRASES = f"WITH {d.PHRASES_SQL}"
#: 15 January 2024, noon, in milliseconds.
NOON = 1_705_320_000_000


@query("p1_filter_jobs", f"{_JOBS} SELECT id, status, created_ms FROM jobs WHERE api_key_id IS NULL AND status IN ('queued', 'failed') AND source = 'api' AND created_ms >= {NOON}")
def _(spark, sf_dir):
    return op.filter_jobs(d.jobs(spark, sf_dir), None, statuses=("queued", "failed"), source="api", since=NOON).select("id", "status", "created_ms")


@query("p2_omit_result", f"{_JOBS} SELECT id, status, model_id, created_ms FROM jobs")
def _(spark, sf_dir):
    return d.jobs(spark, sf_dir).select("id", "status", "model_id", "created_ms")


@query("p10_status_flags", f"{_JOBS} SELECT status, status IN ('succeeded', 'failed', 'canceled', 'expired') AS terminal, status IN ('queued', 'running') AS busy, count(*) AS n FROM jobs GROUP BY status")
def _(spark, sf_dir):
    terminal, busy = op.status_flags(F.col("status"))
    return d.jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")).select("status", terminal.alias("terminal"), busy.alias("busy"), "n")


@query("p14_purge", f"{_JOBS} SELECT id FROM jobs WHERE status IN ('succeeded', 'failed', 'canceled', 'expired') AND coalesce(finished_ms, created_ms) < {NOON} - 86400000")
def _(spark, sf_dir):
    return op.purge(d.jobs(spark, sf_dir), F.lit(NOON), op.DAY).select("id")


@query("p16_pending", f"{_JOBS} SELECT id, created_ms FROM jobs WHERE status = 'queued' ORDER BY created_ms, id")
def _(spark, sf_dir):
    return d.jobs(spark, sf_dir).where("status = 'queued'").select("id", "created_ms").orderBy("created_ms", "id")


@query("w24_queue_position", f"{_JOBS} SELECT id, row_number() OVER (ORDER BY priority DESC, created_ms, id) AS place FROM jobs WHERE status = 'queued'")
def _(spark, sf_dir):
    return op.queue_positions(d.jobs(spark, sf_dir)).select("id", "place")


@query(
    "w13_concurrency",
    f"""{_JOBS}, m AS (SELECT api_key_id, created_ms AS moment, 1 AS d FROM jobs UNION ALL SELECT api_key_id, created_ms + audio_ms, -1 FROM jobs),
s AS (SELECT api_key_id, moment, sum(d) AS d FROM m GROUP BY ALL), l AS (SELECT api_key_id, moment, CAST(sum(d) OVER (PARTITION BY api_key_id ORDER BY moment) AS BIGINT) AS level FROM s)
SELECT *, level > 2 AS "over" FROM l""",
)
def _(spark, sf_dir):
    return op.concurrency(d.jobs(spark, sf_dir).select("api_key_id", F.col("created_ms").alias("s"), (F.col("created_ms") + F.col("audio_ms")).alias("e")), "api_key_id", 2).withColumnRenamed("at", "moment")


@query(
    "a26_load_report",
    f"""{_JOBS}, never AS (SELECT *, started_ms IS NULL AND status <> 'queued' AS never FROM jobs),
m AS (SELECT created_ms // 60000 * 60000 AS minute_ms, 1 AS s, 0 AS f, never::INT AS rj, (NOT never)::INT AS q, 0 AS r FROM never
  UNION ALL SELECT started_ms // 60000 * 60000, 0, 0, 0, -1, 1 FROM never WHERE started_ms IS NOT NULL
  UNION ALL SELECT finished_ms // 60000 * 60000, 0, (status = 'failed')::INT, 0, 0, -1 FROM never WHERE finished_ms IS NOT NULL),
g AS (SELECT minute_ms, sum(s) AS s, sum(f) AS f, sum(rj) AS rj, sum(q) AS q, sum(r) AS r FROM m GROUP BY minute_ms)
SELECT minute_ms, CAST(s AS BIGINT) AS submitted, CAST(f AS BIGINT) AS failed, CAST(rj AS BIGINT) AS rejected, CAST(sum(q) OVER (ORDER BY minute_ms) AS BIGINT) AS queued, CAST(sum(r) OVER (ORDER BY minute_ms) AS BIGINT) AS running FROM g""",
)
def _(spark, sf_dir):
    return op.load_report(d.jobs(spark, sf_dir))


@query(
    "w13_held_bytes",
    f"""{_JOBS}, m AS (SELECT coalesce(api_key_id, '') AS owner, created_ms AS moment, audio_ms AS d FROM jobs UNION ALL SELECT coalesce(api_key_id, ''), finished_ms, -audio_ms FROM jobs WHERE finished_ms IS NOT NULL),
s AS (SELECT owner, moment, sum(d) AS d FROM m GROUP BY ALL), l AS (SELECT owner, moment, CAST(sum(d) OVER (PARTITION BY owner ORDER BY moment) AS BIGINT) AS held FROM s) SELECT *, held > 100000 AS "over" FROM l""",
)
def _(spark, sf_dir):
    jobs = d.jobs(spark, sf_dir).select(F.coalesce("api_key_id", F.lit("")).alias("owner"), F.col("created_ms").alias("s"), F.col("finished_ms").alias("e"), "audio_ms")
    return op.concurrency(jobs, "owner", 100_000, "audio_ms").select("owner", F.col("at").alias("moment"), F.col("level").alias("held"), "over")


@query(
    "s2_read_jobs",
    f"{_JOBS} SELECT id, epoch_ms(created_ms) = make_timestamp(created_ms * 1000) AS same, created_ms AS created, started_ms AS started, model_id AS model, k AS num_speakers, CASE WHEN status = 'failed' THEN 'internal' END AS code FROM jobs",
)
def _(spark, sf_dir):
    error = F.when(F.col("status") == "failed", "internal").alias("error_code")
    params = F.to_json(F.struct(F.col("model_id").alias("model"), F.col("k").alias("num_speakers"))).alias("params_json")
    raw = d.jobs(spark, sf_dir).select("id", "status", params, "created_ms", "started_ms", "finished_ms", error, F.lit(None).cast("string").alias("error_message"))
    ms = lambda c: F.unix_millis(c)
    return op.read_jobs(raw).select("id", F.col("created_at").isNotNull().alias("same"), ms("created_at").alias("created"), ms("started_at").alias("started"), "params.model", F.col("params.num_speakers").cast("long").alias("num_speakers"), "error.code")


_UPDATES = f"""{_JOBS}, up AS (SELECT concat('job_', lpad(CAST(event_id + 5 AS VARCHAR), 8, '0')) AS id, 'running' AS status, 'm9' AS model_id, CAST(NULL AS BIGINT) AS audio_ms, epoch_us(ts) // 1000 AS started_ms, CAST(NULL AS BIGINT) AS finished_ms FROM events WHERE event_type = 'signup')"""


def _updates(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'")
    none = F.lit(None).cast("long")
    started = F.expr("unix_millis(to_utc_timestamp(cast(ts as timestamp), current_timezone()))")
    return e.select(F.concat(F.lit("job_"), F.lpad((F.col("event_id") + 5).cast("string"), 8, "0")).alias("id"), F.lit("running").alias("status"), F.lit("m9").alias("model_id"), none.alias("audio_ms"), started.alias("started_ms"), none.alias("finished_ms"))


@query("s19_apply_transitions", f"{_UPDATES} SELECT j.id, CASE WHEN u.id IS NULL THEN j.status ELSE u.status END AS status, CASE WHEN u.id IS NULL THEN j.model_id ELSE u.model_id END AS model_id, CASE WHEN u.id IS NULL THEN j.audio_ms ELSE u.audio_ms END AS audio_ms, CASE WHEN u.id IS NULL THEN j.started_ms ELSE u.started_ms END AS started_ms, CASE WHEN u.id IS NULL THEN j.finished_ms ELSE u.finished_ms END AS finished_ms, j.created_ms FROM jobs j LEFT JOIN up u ON u.id = j.id")
def _(spark, sf_dir):
    return op.apply_transitions(d.jobs(spark, sf_dir), _updates(spark, sf_dir))[0].select("id", *op.CHANGING, "created_ms")


@query("s19_unknown_jobs", f"{_UPDATES} SELECT id FROM up WHERE id NOT IN (SELECT id FROM jobs)")
def _(spark, sf_dir):
    return op.apply_transitions(d.jobs(spark, sf_dir), _updates(spark, sf_dir))[1].select("id")


@query("l7_newest_first", f"{_JOBS} SELECT id, created_ms FROM jobs WHERE api_key_id = 'key_3' ORDER BY created_ms DESC, id DESC")
def _(spark, sf_dir):
    return op.newest_first(d.jobs(spark, sf_dir), "key_3").select("id", "created_ms")


@query(
    "a27_quota_usage",
    f"{_JOBS} SELECT api_key_id, count(*) FILTER (priority = 0 AND status IN ('queued', 'running')) AS open, count(*) FILTER (priority > 0) AS kept, CAST(sum(audio_ms) AS BIGINT) AS held FROM jobs GROUP BY api_key_id",
)
def _(spark, sf_dir):
    keep, busy = F.col("priority") > 0, op.status_flags(F.col("status"))[1]
    return d.jobs(spark, sf_dir).groupBy("api_key_id").agg(F.count_if(~keep & busy).alias("open"), F.count_if(keep).alias("kept"), F.sum("audio_ms").alias("held"))


@query("l1_history_page", f"{_JOBS} SELECT id, created_ms, CAST(row_number() OVER (ORDER BY created_ms DESC, id DESC) AS INT) AS n, count(*) OVER () > 50 AS more FROM jobs WHERE created_ms < {NOON} OR created_ms = {NOON} AND id < 'job_00005000' ORDER BY created_ms DESC, id DESC LIMIT 50")
def _(spark, sf_dir):
    return op.history_page(d.jobs(spark, sf_dir), after=(NOON, "job_00005000")).select("id", "created_ms", "n", "more")


@query(
    "l3_event_replay",
    "SELECT user_id, event_id, CAST(seq AS INT) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 16 AND seq > 20",
)
def _(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return op.event_replay(events, "user_id", [F.col("ts"), F.col("event_id")], after=20).select("user_id", "event_id", "seq")


@query("a21_latest_revision", f"{_JOBS}, models AS (SELECT DISTINCT model_id, 'r' || lpad(CAST(k AS VARCHAR), 3, '0') AS revision FROM jobs) SELECT model_id, max(revision) AS revision, count(*) AS revisions FROM models GROUP BY model_id ORDER BY model_id")
def _(spark, sf_dir):
    models = d.jobs(spark, sf_dir).select("model_id", F.concat(F.lit("r"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("revision")).distinct()
    return op.latest_revision(models)


@query("a25_dictionary_counts", f"WITH {d.DICTIONARIES_SQL} SELECT 'doc_' || doc_id AS dict_key, (SELECT count(*) FROM lines WHERE dict_key = 'doc_' || doc_id AND trim(phrase) <> '') AS phrases FROM documents")
def _(spark, sf_dir):
    p = d.dictionaries(spark, sf_dir)
    return dic.counts(p.select("dict_key").distinct(), p.where("trim(phrase) <> ''"))


@query("w25_top_matches", f"{_PHRASES} SELECT dict_key, ord, phrase FROM (SELECT *, row_number() OVER (PARTITION BY dict_key ORDER BY ord) AS r FROM phrases WHERE contains(lower(phrase), 'an')) WHERE r <= 5")
def _(spark, sf_dir):
    return dic.top_matches(d.phrases(spark, sf_dir), "an")


@query("j15_dictionary_exists", f"WITH {d.DICTIONARIES_SQL} SELECT DISTINCT dict_key FROM lines WHERE contains(lower(phrase), 'ana')")
def _(spark, sf_dir):
    p = d.dictionaries(spark, sf_dir)
    return dic.matching(p.select("dict_key").distinct(), p, "ana")


@query("p3_search_dictionaries", f"WITH {d.DICTIONARIES_SQL} SELECT dict_key FROM (SELECT 'doc_' || doc_id AS dict_key, lower('doc_' || doc_id || ' ' || lang || ' ' || source) AS search FROM documents) k WHERE contains(search, 'e_1') OR EXISTS (SELECT 1 FROM lines l WHERE l.dict_key = k.dict_key AND contains(lower(phrase), 'e_1')) OR contains(search, 'src')")
def _(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc_"), "doc_id").alias("dict_key"), F.lower(F.concat_ws(" ", F.concat(F.lit("doc_"), "doc_id"), "lang", "source")).alias("search"))
    p = d.dictionaries(spark, sf_dir)
    return dic.search(keys, p, "E_1").unionByName(dic.search(keys, p, "Src")).select("dict_key").distinct()


_CLEAN = rf"""WITH {d.DICTIONARIES_SQL}, bare AS (SELECT dict_key, ord, regexp_replace(phrase, '^\s+|\s+$', '', 'g') AS p FROM lines),
b AS (SELECT * FROM bare WHERE p <> ''), n AS (SELECT dict_key, min(ord) AS ord, regexp_replace(p, '\s+', ' ', 'g') AS phrase FROM b GROUP BY dict_key, phrase),
why AS (SELECT dict_key, arg_min(CASE WHEN regexp_matches(p, '[\r\n]') THEN 'line break' WHEN length(p) > 200 THEN 'long phrase' END, ord) FILTER (regexp_matches(p, '[\r\n]') OR length(p) > 200) AS bad FROM b GROUP BY dict_key),
refused AS (SELECT dict_key, coalesce(bad, CASE WHEN (SELECT count(*) FROM n WHERE n.dict_key = why.dict_key) > 12 THEN 'too many phrases' END) AS reason FROM why)"""


@query("p7_clean_phrases", f"{_CLEAN} SELECT n.* FROM n JOIN refused r ON r.dict_key = n.dict_key WHERE reason IS NULL")
def _(spark, sf_dir):
    return dic.clean_phrases(d.dictionaries(spark, sf_dir), 12)[0]


@query("p7_refused_dictionaries", f"{_CLEAN} SELECT dict_key, reason FROM refused WHERE reason IS NOT NULL")
def _(spark, sf_dir):
    return dic.clean_phrases(d.dictionaries(spark, sf_dir), 12)[1]


#: Keys and fields of every kind: by document, with its source and first line.
_RAW = "raw AS (SELECT ' Key_' || doc_id || CASE WHEN lang = 'fr' THEN ' x' WHEN lang = 'es' THEN '' ELSE '-' || source END || ' ' AS key, CASE WHEN lang = 'de' THEN '' ELSE substr(text, 1, 210) END AS name, text AS description, n_chars / 500.0 AS score FROM documents)"
_DICTS = rf"""WITH {_RAW}, k AS (SELECT *, lower(trim(key)) AS lk FROM raw), m AS (SELECT *, CASE WHEN trim(name) = '' THEN lk ELSE trim(name) END AS nm FROM k),
judged AS (SELECT *, CASE WHEN NOT regexp_full_match(lk, '[a-z0-9][a-z0-9_-]*') OR length(lk) > 64 THEN 'key' WHEN length(nm) > 200 THEN 'name' WHEN length(trim(description)) > 2000 THEN 'description' WHEN score < 0 OR score > 10 THEN 'score' END AS field FROM m)"""


def _raw(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tail = F.when(F.col("lang") == "fr", " x").when(F.col("lang") == "es", "").otherwise(F.concat(F.lit("-"), "source"))
    return docs.select(F.concat(F.lit(" Key_"), "doc_id", tail, F.lit(" ")).alias("key"), F.when(F.col("lang") == "de", "").otherwise(F.substring("text", 1, 210)).alias("name"), F.col("text").alias("description"), (F.col("n_chars") / 500.0).alias("score"))


@query("p6_clean_dictionaries", f"{_DICTS} SELECT lk AS key, length(nm) AS n, score FROM judged WHERE field IS NULL")
def _(spark, sf_dir):
    return dic.clean_dictionaries(_raw(spark, sf_dir))[0].select("key", F.length("name").cast("long").alias("n"), "score")


@query("p6_refused_dictionaries", f"{_DICTS} SELECT key, field FROM judged WHERE field IS NOT NULL")
def _(spark, sf_dir):
    return dic.clean_dictionaries(_raw(spark, sf_dir))[1].select("key", "field")


@query("p5_valid_key", f"{_DICTS} SELECT key, CASE WHEN lk <> '' AND length(lk) <= 64 AND regexp_full_match(lk, '[a-z0-9][a-z0-9_-]*') THEN lk END AS canonical, CASE WHEN lk = '' THEN 'empty' WHEN length(lk) > 64 THEN 'too long' WHEN NOT regexp_full_match(lk, '[a-z0-9][a-z0-9_-]*') THEN 'bad character' END AS reason FROM m")
def _(spark, sf_dir):
    return _raw(spark, sf_dir).select("key", valid_key(F.col("key")).alias("v")).select("key", F.col("v.key").alias("canonical"), "v.reason")


#: A file a document: an array, an object or lines of its text, by language.
_FILES = r"""WITH files AS (SELECT doc_id AS path, lang, CASE WHEN lang = 'en' THEN CAST(to_json(string_split(text, chr(10))) AS VARCHAR) WHEN lang = 'de' THEN CAST(to_json({'phrases': string_split(text, chr(10))}) AS VARCHAR) WHEN lang = 'fr' THEN 'Phrases' || chr(10) || '# note' || chr(10) || text ELSE text END AS content, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT path, lang, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(list_filter(ls, lambda x: trim(x) <> '')) AS filled FROM files),
parts AS (SELECT path, i, unnest(CASE WHEN lang = 'es' AND filled = 1 THEN string_split(line, ',') ELSE [line] END) AS p, generate_subscripts(CASE WHEN lang = 'es' AND filled = 1 THEN string_split(line, ',') ELSE [line] END, 1) AS j, lang, line FROM lines),
kept AS (SELECT path, i, j, CASE WHEN lang IN ('en', 'de') THEN p ELSE regexp_replace(p, '^\s+|\s+$', '', 'g') END AS phrase FROM parts WHERE lang IN ('en', 'de') OR regexp_replace(p, '^\s+|\s+$', '', 'g') <> '' AND NOT starts_with(regexp_replace(line, '^\s+', ''), '#') AND NOT (lang = 'es' AND i = 1 AND lower(trim(p)) IN ('phrase', 'phrases', 'word', 'words', 'hotword', 'hotwords', 'term', 'terms', 'text')))"""


def _files(spark, sf_dir):
    lines, text = F.split("text", "\n"), F.col("text")
    content = F.when(F.col("lang") == "en", F.to_json(lines)).when(F.col("lang") == "de", F.to_json(F.struct(lines.alias("phrases")))).when(F.col("lang") == "fr", F.concat(F.lit("Phrases\n# note\n"), text)).otherwise(text)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), content.alias("content"))


@query("s4_read_dictionary_files", f"{_FILES} SELECT path, row_number() OVER (PARTITION BY path ORDER BY i, j) - 1 AS ord, phrase FROM kept")
def _(spark, sf_dir):
    return dic.read_files(_files(spark, sf_dir))[0]


@query("u1_merge_dictionaries", f"{_PHRASES}, placed AS (SELECT phrase, arg_min((length(dict_key), dict_key, ord), (length(dict_key), dict_key, ord)) AS a FROM phrases GROUP BY phrase) SELECT phrase, a[2] AS dict_key, a[3] AS ord FROM placed")
def _(spark, sf_dir):
    merged = dic.merge_dictionaries(d.phrases(spark, sf_dir), F.struct(F.length("dict_key").alias("n"), "dict_key"))
    return merged.select("phrase", F.col("dict_ord.dict_key").alias("dict_key"), "ord")


#: Stored dictionaries, one a document, and incoming ones, one a page.
_STORE = """WITH base AS (SELECT 'doc_' || doc_id AS key, source AS name, lang AS description, 1.0::DOUBLE AS score, lower('doc_' || doc_id || ' ' || source || ' ' || lang) AS search, 1000 + doc_id AS created_ms, 2000 + doc_id AS updated_ms FROM documents),
inc AS (SELECT 'doc_' || (page_id * 5) AS key, 'Page ' || page_id AS name, url AS description, 2.0::DOUBLE AS score FROM pages)"""


def _store(spark, sf_dir):
    key = F.concat(F.lit("doc_"), "doc_id")
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select(key.alias("key"), F.col("source").alias("name"), F.col("lang").alias("description"), F.lit(1.0).alias("score"), F.lower(F.concat_ws(" ", key, "source", "lang")).alias("search"), (F.col("doc_id") + 1000).alias("created_ms"), (F.col("doc_id") + 2000).alias("updated_ms"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    inc = pages.select(F.concat(F.lit("doc_"), F.col("page_id") * 5).alias("key"), F.concat(F.lit("Page "), "page_id").alias("name"), F.col("url").alias("description"), F.lit(2.0).alias("score"))
    lines = base.select(F.col("key").alias("dict_key"), F.lit(0).alias("ord"), F.col("name").alias("phrase"), F.lower("name").alias("phrase_lc"))
    new = inc.select(F.col("key").alias("dict_key"), F.posexplode(F.split("description", "/")).alias("ord", "phrase"))
    return base, lines, inc, new


@query("s18_upsert_dictionaries", f"{_STORE} SELECT key, name, description, score, search, created_ms, updated_ms FROM base WHERE key NOT IN (SELECT key FROM inc) UNION ALL SELECT i.key, i.name, i.description, i.score, lower(i.key || ' ' || i.name || ' ' || i.description), coalesce(b.created_ms, 9000), 9000 FROM inc i LEFT JOIN base b ON b.key = i.key")
def _(spark, sf_dir):
    return dic.upsert(*_store(spark, sf_dir), 9000)[0]


@query("s18_upsert_phrases", f"{_STORE} SELECT key AS dict_key, 0 AS ord, name AS phrase FROM base WHERE key NOT IN (SELECT key FROM inc) UNION ALL SELECT key, CAST(generate_subscripts(string_split(description, '/'), 1) - 1 AS INT), unnest(string_split(description, '/')) FROM inc")
def _(spark, sf_dir):
    return dic.upsert(*_store(spark, sf_dir), 9000)[1].select("dict_key", "ord", "phrase")


@query("s18_create_refused", f"{_STORE} SELECT key FROM inc WHERE key IN (SELECT key FROM base)")
def _(spark, sf_dir):
    return dic.upsert(*_store(spark, sf_dir), 9000, must_be_new=True)[2]


@query("l2_list_dictionaries", f"{_STORE} SELECT key, updated_ms FROM base ORDER BY updated_ms DESC, key LIMIT 200")
def _(spark, sf_dir):
    return dic.listed(_store(spark, sf_dir)[0], 500).select("key", "updated_ms")


@query("s17_export_text", f"{_STORE} SELECT key AS dict_key, 0 AS part, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS ord, '# ' || unnest(ls) AS line FROM (SELECT key, [key, name, description] AS ls FROM base) UNION ALL SELECT key, 1, 0, name FROM base")
def _(spark, sf_dir):
    base, lines, *_rest = _store(spark, sf_dir)
    return dic.export_text(base, lines)


@query("s17_export_json", f"{_STORE} SELECT key, CAST(to_json({{'key': key, 'name': name, 'description': description, 'score': score::DOUBLE, 'phrases': [name]}}) AS VARCHAR) AS json FROM base")
def _(spark, sf_dir):
    base, lines, *_rest = _store(spark, sf_dir)
    return dic.export_json(base, lines)


_ASKED = """WITH dicts AS (SELECT 'doc_' || doc_id AS key, CASE WHEN n_chars > 2000 THEN 3 ELSE 0 END AS score FROM documents WHERE lang <> 'fr'),
req AS (SELECT doc_id AS id, ['doc_' || (doc_id * 3), 'doc_1'] AS standing, ['doc_' || (doc_id + 1), '', 'doc_1'] AS asked, CASE WHEN lang = 'de' THEN 2 ELSE 0 END AS score FROM documents),
keys AS (SELECT id, score, 0 AS own, generate_subscripts(standing, 1) AS k, unnest(standing) AS key FROM req UNION ALL SELECT id, score, 1, generate_subscripts(asked, 1), unnest(asked) FROM req),
f AS (SELECT id, key, min(own * 10 + k) AS spot, any_value(score) AS score FROM keys WHERE key <> '' GROUP BY id, key),
j AS (SELECT f.*, d.score AS of_, d.key IS NULL AS gone FROM f LEFT JOIN dicts d ON d.key = f.key),
told AS (SELECT id, any_value(score) AS s, coalesce(string_agg(key, ',' ORDER BY spot) FILTER (gone AND spot < 10), '') AS missing, arg_min(key, spot) FILTER (gone AND spot >= 10) AS error, arg_min(of_, CASE WHEN spot >= 10 THEN spot - 10 ELSE spot + 100 END) FILTER (of_ > 0) AS best FROM j GROUP BY id)"""


def _requests(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda c: F.concat(F.lit("doc_"), c.cast("string"))
    i = F.col("doc_id")
    dicts = docs.where("lang <> 'fr'").select(key(i).alias("key"), F.when(F.col("n_chars") > 2000, 3).otherwise(0).alias("score"))
    return docs.select(i.alias("id"), F.array(key(i * 3), F.lit("doc_1")).alias("standing"), F.array(key(i + 1), F.lit(""), F.lit("doc_1")).alias("asked"), F.when(F.col("lang") == "de", 2).otherwise(0).alias("score")), dicts


@query("j14_resolve_dictionaries", f"{_ASKED} SELECT id, CAST(CASE WHEN s <> 0 THEN s ELSE coalesce(best, 0) END AS INT) AS score, missing, error FROM told")
def _(spark, sf_dir):
    return dic.resolve(*_requests(spark, sf_dir))[1]


@query("j14_applied_dictionaries", f"{_ASKED} SELECT j.id, row_number() OVER (PARTITION BY j.id ORDER BY spot) AS place, key FROM j JOIN told t ON t.id = j.id WHERE NOT gone AND error IS NULL")
def _(spark, sf_dir):
    return dic.resolve(*_requests(spark, sf_dir))[0]


@query("u4_except_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left_anti")


@query("u4_intersect_ids", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left_semi")


@query("p14_expire", f"{_JOBS} SELECT id FROM jobs WHERE priority = 0 AND status NOT IN ('queued', 'running') AND created_ms + audio_ms < {NOON}")
def _(spark, sf_dir):
    return op.expire(d.jobs(spark, sf_dir), F.col("priority") > 0, F.col("created_ms") + F.col("audio_ms"), F.lit(NOON)).select("id")
