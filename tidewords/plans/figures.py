"""Queries over figures, warnings, models and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewords.operators import reports as op
from tidewords.operators import wordstream as ws
from tidewords.plans.registry import query
from tidewords.sources import derived as d
from tidewords.sources.shared import settle


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(
    "a6_audio_stats",
    f"""WITH {d.WORDS_SQL}, ch AS (SELECT rec_id, channel, max(end_ms) + 500 * channel AS total FROM words GROUP BY rec_id, channel), l AS (SELECT rec_id, max(total) AS duration_ms FROM ch GROUP BY rec_id),
c AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM words), s AS (SELECT rec_id, sum(greatest(end_ms - greatest(cur, start_ms), 0)) AS speech, 3 * count(*) AS ms FROM c GROUP BY rec_id)
SELECT rec_id, duration_ms, round(speech / duration_ms, 9) AS speech_ratio, round(ms / duration_ms, 9) AS rtf FROM l JOIN s USING (rec_id)""",
)
def _(spark, sf_dir):
    w = settle(d.words(spark, sf_dir))
    channels = w.groupBy("rec_id", "channel").agg((F.max("end_ms") + 500 * F.col("channel")).alias("total"))
    spent = w.groupBy("rec_id").agg((3 * F.count("*")).alias("processing_ms"))
    stats = op.audio_stats(w.select("rec_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")), channels, spent)
    return stats.withColumns({c: F.round(c, 9) for c in ("speech_ratio", "rtf")})


@query("a7_merge_stage_stats", f"WITH {d.JOBS_SQL} SELECT user_id AS rec_id, CAST(sum(k) AS BIGINT) AS decode, CAST(2 * sum(k) AS BIGINT) AS vad, CAST(5 * sum(k) FILTER (status = 'succeeded') AS BIGINT) AS asr FROM jobs GROUP BY user_id")
def _(spark, sf_dir):
    j = d.jobs(spark, sf_dir)
    base = F.create_map(F.lit("decode"), F.col("k"), F.lit("vad"), 2 * F.col("k"))
    stages = F.when(F.col("status") == "succeeded", F.map_concat(base, F.create_map(F.lit("asr"), 5 * F.col("k")))).otherwise(base)
    merged = op.merge_stage_stats(j.select(F.col("user_id").alias("rec_id"), stages.alias("stages")))
    return merged.select("rec_id", *(F.try_element_at("stages", F.lit(s)).alias(s) for s in ("decode", "vad", "asr")))


def _warnings(spark, sf_dir):
    return _read(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), F.struct("ts", "event_id").alias("ord"), F.col("event_type").alias("code"), F.col("event_id").cast("string").alias("message"))


_FIRST = "SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY o) - 1 AS place, code, message FROM (SELECT user_id AS rec_id, event_type AS code, min((ts, event_id)) AS o, CAST({pick}(event_id, (ts, event_id)) AS VARCHAR) AS message FROM events GROUP BY ALL)"


@query("a8_warnings_first", _FIRST.replace("{pick}", "arg_min"))
def _(spark, sf_dir):
    return op.merge_warnings(_warnings(spark, sf_dir))


@query("a8_warnings_last", _FIRST.replace("{pick}", "arg_max"))
def _(spark, sf_dir):
    return op.merge_warnings(_warnings(spark, sf_dir), last=True)


@query("a28_transcript_progress", f"WITH {d.JOBS_SQL} SELECT user_id AS rec_id, CAST(sum(CASE WHEN status = 'succeeded' THEN 100 ELSE k END) // count(*) AS BIGINT) AS percent FROM jobs GROUP BY user_id")
def _(spark, sf_dir):
    return op.transcript_progress(d.jobs(spark, sf_dir).select(F.col("user_id").alias("rec_id"), "status", F.col("k").alias("percent")))


_RECS = f"WITH {d.SPOKEN_SQL}, recs AS (SELECT rec_id, count(*) AS segments, count(DISTINCT speaker) AS found, rec_id % 4 AS asked, rec_id % 3 = 0 AS takes_count, max(n_words) > 20 AS timed FROM spoken GROUP BY rec_id)"


def _recs(spark, sf_dir):
    s = d.spoken(d.words(spark, sf_dir))
    return s.groupBy("rec_id").agg(F.count("*").alias("segments"), F.count_distinct("speaker").alias("found"), (F.max("n_words") > 20).alias("timed")).withColumns({"asked": F.col("rec_id") % 4, "takes_count": F.col("rec_id") % 3 == 0})


@query("a29_diarization_warnings", f"{_RECS} SELECT rec_id, CASE WHEN asked > 1 AND found < asked THEN 'diarization_fewer_speakers' WHEN asked > 0 AND found > asked AND NOT takes_count THEN 'diarization_more_speakers' END AS warning FROM recs")
def _(spark, sf_dir):
    return op.diarization_warnings(_recs(spark, sf_dir)).select("rec_id", "warning")


_CODES = "CASE WHEN NOT timed THEN 'word_timestamps_unavailable,' ELSE '' END || CASE WHEN asked > 1 AND NOT takes_count THEN 'punctuation_unavailable,' ELSE '' END || CASE WHEN asked = 3 THEN 'itn_unavailable,' ELSE '' END"


def _warned(spark, sf_dir):
    r = _recs(spark, sf_dir).withColumns({"punctuation_asked": F.col("asked") > 1, "punctuation_possible": F.col("takes_count"), "itn_asked": F.col("asked") == 3, "itn_possible": F.lit(False)})
    return op.result_warnings(r)


@query("a30_result_warnings", f"{_RECS} SELECT rec_id, CASE WHEN timed THEN 'token' ELSE 'segment' END AS timestamp_source, rtrim({_CODES}, ',') AS codes FROM recs")
def _(spark, sf_dir):
    return _warned(spark, sf_dir).select("rec_id", "timestamp_source", F.array_join("warnings", ",").alias("codes"))


@query("p11_strict_reject", f"{_RECS}, c AS (SELECT rec_id, CASE WHEN rec_id % 5 = 0 THEN 'language_mismatch,' WHEN rec_id % 5 = 1 THEN 'no_speech_detected,' ELSE '' END || {_CODES} AS codes FROM recs) SELECT rec_id, list_filter(string_split(codes, ','), lambda w: w LIKE '%\\_unavailable' ESCAPE '\\' OR w = 'language_mismatch')[1] AS error FROM c".replace("\\\\", "\\"))
def _(spark, sf_dir):
    more = F.when(F.col("rec_id") % 5 == 0, F.array(F.lit("language_mismatch"))).when(F.col("rec_id") % 5 == 1, F.array(F.lit("no_speech_detected"))).otherwise(F.array().cast("array<string>"))
    return op.strict_reject(_warned(spark, sf_dir).withColumn("warnings", F.concat(more, "warnings"))).select("rec_id", "error")


@query(
    "p17_check_spans",
    "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE list_transform(string_split(text, chr(10)), lambda l: CASE WHEN l = '' AND doc_id % 3 = 0 THEN 0 ELSE 1 + length(l) % 3 END) END AS sp, len(string_split(text, chr(10))) AS n FROM documents), r AS (SELECT doc_id, sp, n + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS outputs, CASE WHEN sp IS NULL THEN n ELSE list_sum(sp) + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END END AS inputs FROM s) SELECT doc_id, CASE WHEN sp IS NULL THEN 'counts differ without spans' WHEN len(sp) <> outputs THEN 'a span is missing' WHEN list_min(sp) < 1 THEN 'an output covers nothing' ELSE 'inputs are left over' END AS violation FROM r WHERE CASE WHEN sp IS NULL THEN inputs <> outputs ELSE len(sp) <> outputs OR list_min(sp) < 1 OR list_sum(sp) <> inputs END",
)
def _(spark, sf_dir):
    i, lines = F.col("doc_id"), F.split("text", "\n")
    spans = F.transform(lines, lambda x: F.when((x == "") & (i % 3 == 0), 0).otherwise(1 + F.length(x) % 3))
    s = _read(spark, sf_dir, "documents").select("doc_id", F.when(i % 7 != 0, spans).alias("spans"), F.size(lines).alias("n"))
    total = F.aggregate("spans", F.lit(0), lambda a, x: a + x)
    rows = s.withColumns({"outputs": F.col("n") + F.when(i % 11 == 0, 1).otherwise(0), "inputs": F.when(F.col("spans").isNull(), F.col("n")).otherwise(total + F.when(i % 5 == 0, 2).otherwise(0))})
    return op.check_spans(rows).select("doc_id", "violation")


_LOCALES = ("en-US", "en-GB", "de-DE", "fr-FR", "nb-NO", "es-ES")
_ASKED = "CASE doc_id % 6 WHEN 0 THEN lang WHEN 1 THEN ' ' || upper(lang) || '_' || upper(lang) WHEN 2 THEN lang || '-XX' WHEN 3 THEN 'auto' WHEN 4 THEN 'no' ELSE '' END"
_RESOLVED = f"WITH r AS (SELECT doc_id, lang AS own, {_ASKED} AS lang, {list(_LOCALES)} AS locales FROM documents), w AS (SELECT *, CASE WHEN lower(replace(trim(lang), '_', '-')) = 'no' THEN 'nb' ELSE lower(replace(trim(lang), '_', '-')) END AS want FROM r), l AS (SELECT *, CASE WHEN want IN ('', 'auto') THEN 'auto' ELSE coalesce(list_filter(locales, lambda x: lower(x) = want)[1], CASE WHEN NOT contains(want, '-') THEN list_filter(locales, lambda x: split_part(lower(x), '-', 1) = want)[1] END) END AS locale FROM w)"


def _asked(spark, sf_dir):
    i, own = F.col("doc_id") % 6, F.col("lang")
    lang = F.when(i == 0, own).when(i == 1, F.concat(F.lit(" "), F.upper(own), F.lit("_"), F.upper(own))).when(i == 2, F.concat(own, F.lit("-XX"))).when(i == 3, "auto").when(i == 4, "no").otherwise("")
    return _read(spark, sf_dir, "documents").select("doc_id", own.alias("own"), lang.alias("lang"))


@query("j9_resolve_locale", f"{_RESOLVED} SELECT doc_id, locale FROM l")
def _(spark, sf_dir):
    return op.resolve_locale(_asked(spark, sf_dir), F.array(*map(F.lit, _LOCALES))).select("doc_id", "locale")


@query("p18_language_supported", f"{_RESOLVED} SELECT doc_id, CASE WHEN want IN ('', 'auto') THEN true WHEN doc_id % 2 = 0 THEN locale IS NOT NULL ELSE own = 'es' OR split_part(lower(replace(trim(lang), '_', '-')), '-', 1) = own END AS supported FROM l")
def _(spark, sf_dir):
    rows = _asked(spark, sf_dir).withColumns({"languages": F.when(F.col("own") == "es", F.array(F.lit("multi"))).otherwise(F.array(F.concat("own", F.lit("-A")))), "locales": F.array(*map(F.lit, _LOCALES)), "multilingual": F.col("doc_id") % 2 == 0})
    return op.language_supported(rows).select("doc_id", "supported")


#: Every known code, as it is, with a region, in capitals with one, and codes that nobody knows.
_CODES = ", ".join(f"('{c}', '{n}')" for c, n in [*op.LANGUAGES.items(), ("xx", "")])


@query(
    "j10_language_name",
    f"""WITH k AS (SELECT c, n, row_number() OVER () - 1 AS i FROM (VALUES {_CODES}) v(c, n)),
a AS (SELECT doc_id, c, n, CASE doc_id // 42 % 3 WHEN 0 THEN c WHEN 1 THEN c || '-ZZ' ELSE upper(c) || '_zz' END AS code FROM documents JOIN k ON i = doc_id % 42)
SELECT doc_id, CASE WHEN n = '' THEN code ELSE n END AS name, CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM a""".replace("42", str(len(op.LANGUAGES) + 1)),
)
def _(spark, sf_dir):
    known = [*op.LANGUAGES, "xx"]
    docs, i = _read(spark, sf_dir, "documents"), F.col("doc_id")
    c = F.element_at(F.array(*map(F.lit, known)), (i % len(known) + 1).cast("int"))
    turn = F.floor(i / len(known)) % 3
    code = F.when(turn == 0, c).when(turn == 1, F.concat(c, F.lit("-ZZ"))).otherwise(F.concat(F.upper(c), F.lit("_zz")))
    name, confidence = op.language_name(code, F.when(i % 2 == 0, F.array("lang")).otherwise(F.array("lang", F.lit("x"))))
    return docs.select("doc_id", name.alias("name"), confidence.alias("confidence"))


_MODELS = "WITH m AS (SELECT doc_id, ['transducer', 'ctc', 'streaming_transducer'][doc_id % 3 + 1] AS family, ['greedy_search', 'modified_beam_search', '', 'other'][doc_id % 4 + 1] AS method, ['bpe', 'char', 'cjkchar', 'cjkchar+bpe', 'bpe'][doc_id % 5 + 1] AS unit, lang <> 'de' AS has_vocab FROM documents)"


@query("p19_hotword_capability", f"{_MODELS} SELECT doc_id, CASE WHEN family = 'streaming_transducer' THEN 'streaming' WHEN family <> 'transducer' THEN 'family' WHEN method <> 'modified_beam_search' THEN 'decoding' WHEN unit = 'cjkchar' THEN NULL WHEN unit = 'char' THEN 'unit' WHEN NOT has_vocab THEN 'vocabulary' END AS reason, method IN ('', 'greedy_search') OR method = 'modified_beam_search' AND family <> 'ctc' AS decodes FROM m")
def _(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    m = _read(spark, sf_dir, "documents").select("doc_id", pick(("transducer", "ctc", "streaming_transducer")).alias("family"), pick(("greedy_search", "modified_beam_search", "", "other")).alias("method"), pick(("bpe", "char", "cjkchar", "cjkchar+bpe", "bpe")).alias("unit"), (F.col("lang") != "de").alias("has_vocab"))
    return op.hotword_capability(m).select("doc_id", "reason", "decodes")


@query("j17_not_installed", f"WITH {d.JOBS_SQL}, catalog AS (SELECT DISTINCT model_id || '@' || k AS model_id FROM jobs), here AS (SELECT DISTINCT model_id || '@' || k AS model_id FROM jobs WHERE status = 'succeeded') SELECT model_id FROM catalog WHERE model_id NOT IN (SELECT model_id FROM here)")
def _(spark, sf_dir):
    j = d.jobs(spark, sf_dir).select("status", F.concat_ws("@", "model_id", "k").alias("model_id"))
    return op.not_installed(j.select("model_id").distinct(), j.where("status = 'succeeded'").select("model_id").distinct())


_HEADS = ("52494646000000005741564566", "52494646000000004156492066", "664C6143", "4F676753", "494433", "FFFB90", "FF4190", "000000186674797069736F6D", "2321414D520A", "1A45DFA3", "63616666", "2E736E64", "")
_FORMATS = ("wav", "unknown", "flac", "ogg", "mp3", "mp3", "unknown", "mp4", "amr", "mkv", "caf", "au", "unknown")


@query("s6_media_inventory", f"SELECT {list(_FORMATS)}[doc_id % {len(_FORMATS)} + 1] AS format, count(*) AS files, CAST(sum(strlen(text) + length({list(_HEADS)}[doc_id % {len(_HEADS)} + 1]) // 2) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def _(spark, sf_dir):
    head = F.unhex(F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS) + 1).cast("int")))
    return op.media_inventory(_read(spark, sf_dir, "documents").select(F.concat(head, F.col("text").cast("binary")).alias("content")))


@query("s5_read_vocabulary", f"WITH {d.TOKENS_SQL} SELECT rec_id AS model, CASE WHEN k = 1 THEN ' ' ELSE token END AS token, wid * 100 + k AS id FROM tokens")
def _(spark, sf_dir):
    t = d.tokens(d.words(spark, sf_dir))
    line = F.concat_ws(" ", F.when(F.col("k") == 1, " ").otherwise(F.col("token")), (F.col("wid") * 100 + F.col("k")).cast("string"))
    return op.read_vocabulary(t.select(F.col("rec_id").alias("model"), line.alias("line")))


@query(
    "a23_modeling_unit",
    f"WITH {d.TOKENS_SQL}, v AS (SELECT rec_id, CASE rec_id % 5 WHEN 0 THEN token WHEN 1 THEN substr(replace(token, '▁', ''), 1, 1) WHEN 2 THEN chr((19968 + wid)::INT) WHEN 3 THEN CASE WHEN k = 0 THEN token ELSE chr((19968 + wid)::INT) END ELSE replace(token, '▁', '') || 'q' END AS token FROM tokens), c AS (SELECT rec_id, count(*) AS n, count(*) FILTER (contains(token, '▁')) AS m, count(*) FILTER (length(replace(token, '▁', '')) = 1) AS s, count(*) FILTER (length(replace(token, '▁', '')) = 1 AND ord(replace(token, '▁', '')) BETWEEN 19968 AND 40959) AS cj FROM v WHERE trim(token) <> '' AND NOT token LIKE '<%>' GROUP BY rec_id) SELECT rec_id AS model, CASE WHEN m > 0 AND 4 * cj > n THEN 'cjkchar+bpe' WHEN m > 0 THEN 'bpe' WHEN 2 * cj > n THEN 'cjkchar' WHEN 10 * s > 9 * n THEN 'char' ELSE 'bpe' END AS unit FROM c",
)
def _(spark, sf_dir):
    t, r = d.tokens(d.words(spark, sf_dir)), F.col("rec_id") % 5
    bare, sign = F.replace("token", F.lit("▁")), F.decode(F.unhex(F.lpad(F.hex(F.col("wid") + 19968), 4, "0")), "UTF-16BE")
    token = F.when(r == 0, F.col("token")).when(r == 1, F.substring(bare, 1, 1)).when(r == 2, sign).when(r == 3, F.when(F.col("k") == 0, F.col("token")).otherwise(sign)).otherwise(F.concat(bare, F.lit("q")))
    return op.modeling_unit(t.select(F.col("rec_id").alias("model"), token.alias("token")))


@query("w27_route_channels", f"{_RECS} SELECT rec_id, CASE WHEN asked = 0 THEN 'none' WHEN takes_count AND found > 1 THEN 'split' WHEN NOT timed THEN 'none' ELSE 'diarize' END AS route, CASE WHEN asked = 0 THEN NULL WHEN takes_count AND found > 1 THEN 'diarization_skipped_split' WHEN NOT timed THEN 'diarization_unavailable' END AS warning FROM recs")
def _(spark, sf_dir):
    r = _recs(spark, sf_dir).select("rec_id", (F.col("asked") > 0).alias("diarize"), F.when(F.col("takes_count"), "split").otherwise("mono").alias("mode"), F.col("found").alias("channels"), F.col("timed").alias("enabled"), "segments")
    return op.route_channels(r).select("rec_id", "route", "warning")


_BATCHES = f"""WITH RECURSIVE {d.SPOKEN_SQL}, l AS (SELECT rec_id, id, (end_ms - start_ms) * 4 AS ms FROM spoken),
walk AS (SELECT rec_id, id, ms, 1 AS n, 0 AS batch FROM l WHERE id = 0 UNION ALL
  SELECT l.rec_id, l.id, CASE WHEN w.n >= 8 OR w.ms + l.ms > 60000 THEN l.ms ELSE w.ms + l.ms END, CASE WHEN w.n >= 8 OR w.ms + l.ms > 60000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 8 OR w.ms + l.ms > 60000 THEN w.batch + 1 ELSE w.batch END FROM walk w JOIN l ON l.rec_id = w.rec_id AND l.id = w.id + 1)"""


@query("w17_pack_batches", f"{_BATCHES} SELECT rec_id, id, batch FROM walk")
def _(spark, sf_dir):
    s = d.spoken(d.words(spark, sf_dir)).select("rec_id", "id", ((F.col("end_ms") - F.col("start_ms")) * 4).alias("length_ms"))
    return op.pack_batches(s).select("rec_id", "id", "batch")


#: Windows of a recording are 64 embeddings in a row; a speaker's first one in it is the reference.
@query("j19_gate_by_speaker", "WITH w AS (SELECT vec_id // 64 AS rec_id, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), refs AS (SELECT rec_id, label, arg_min(e, vec_id) AS r FROM w GROUP BY ALL), c AS (SELECT w.rec_id, w.vec_id, w.label, r.label AS other, list_cosine_similarity(e, r) AS c FROM w JOIN refs r USING (rec_id)) SELECT rec_id, vec_id, coalesce(max(c) FILTER (other = label) >= 0.25 AND NOT coalesce(max(c) FILTER (other <> label), -2) > max(c) FILTER (other = label), false) AS own FROM c GROUP BY ALL")
def _(spark, sf_dir):
    w = _read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("rec_id"), F.col("vec_id").alias("window"), F.col("label").alias("speaker"), "embedding")
    refs = w.groupBy("rec_id", "speaker").agg(F.min_by("embedding", "window").alias("embedding"))
    return op.gate_by_speaker(w, refs).select("rec_id", F.col("window").alias("vec_id"), "own")


def _said(spark, sf_dir):
    w = d.words(spark, sf_dir)
    s = d.spoken(w)
    return s, d.spoken_words(w, s)


@query("w1b_segment_fallback", f"WITH {d.SPOKEN_SQL} SELECT rec_id, id, seq, word, start_ms, end_ms FROM said WHERE speaker = 'spk_0' UNION ALL SELECT rec_id, id, 0, text, start_ms, end_ms FROM spoken WHERE speaker IS DISTINCT FROM 'spk_0'")
def _(spark, sf_dir):
    s, w = _said(spark, sf_dir)
    return ws.segment_fallback(s, w.where("speaker = 'spk_0'"))[0]


@query("w1b_timestamp_source", f"WITH {d.SPOKEN_SQL} SELECT rec_id, CASE WHEN bool_or(speaker IS NULL) THEN 'token' ELSE 'segment' END AS timestamp_source, CASE WHEN bool_or(speaker IS NULL) THEN NULL ELSE 'word_timestamps_unavailable' END AS warning FROM spoken GROUP BY rec_id")
def _(spark, sf_dir):
    s, w = _said(spark, sf_dir)
    return ws.segment_fallback(s, w.where("speaker IS NULL"))[1]


#: Outputs of a stage that joins words two by two over the borders of segments.
@query("j18_scatter_words", f"WITH {d.SPOKEN_SQL} SELECT rec_id, seq // 2 AS ord, arg_min(id, seq) AS id FROM said GROUP BY rec_id, seq // 2")
def _(spark, sf_dir):
    s, w = _said(spark, sf_dir)
    outputs = w.groupBy("rec_id", F.floor(F.col("seq") / 2).alias("ord")).agg(F.count("*").alias("span"))
    return ws.scatter_words(outputs, s.select("rec_id", "id", F.col("n_words").alias("n"))).select("rec_id", "ord", "id")


@query("w12_compose_spans", f"WITH {d.WORDS_SQL} SELECT rec_id, wid // 6 AS ord, count(*) AS span FROM words GROUP BY ALL")
def _(spark, sf_dir):
    w = settle(d.words(spark, sf_dir))
    first = w.groupBy("rec_id", F.floor(F.col("wid") / 2).alias("ord")).agg(F.count("*").alias("span"))
    second = first.groupBy("rec_id", F.floor(F.col("ord") / 3).alias("ord")).agg(F.count("*").alias("span"))
    return ws.compose_spans(first, second)


@query("w23_reattach_text", f"WITH {d.WORDS_SQL}, w AS (SELECT *, rec_id % 3 = 0 AND wid // 200 = 0 AS other FROM words) SELECT rec_id, wid // 200 AS chunk, string_agg(CASE WHEN other THEN lower(regexp_replace(word, '[.,!?]+$', '')) ELSE word END, ' ' ORDER BY wid) AS text FROM w GROUP BY rec_id, wid // 200")
def _(spark, sf_dir):
    w = d.words(spark, sf_dir).select("rec_id", F.floor(F.col("wid") / 200).alias("chunk"), F.col("wid").alias("seq"), "word")
    text = lambda sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"]), sep).alias("text")
    wrote = w.groupBy("rec_id", "chunk").agg(text("  "))
    other = (F.col("rec_id") % 3 == 0) & (F.col("chunk") == 0)
    wrote = wrote.select("rec_id", "chunk", F.when(other, F.concat(F.lit("zzz "), "text")).otherwise(F.col("text")).alias("punctuated"))
    bare = w.withColumn("word", F.lower(F.regexp_replace("word", "[.,!?]+$", "")))
    return ws.reattach_text(bare, wrote, ["rec_id", "chunk"]).groupBy("rec_id", "chunk").agg(text(" "))


@query("u2_union_tracks", f"WITH {d.SPOKEN_SQL} SELECT rec_id, id, channel, text FROM spoken WHERE channel = 0 UNION ALL SELECT rec_id, id, channel, text FROM spoken WHERE channel = 1")
def _(spark, sf_dir):
    s = settle(d.spoken(d.words(spark, sf_dir)).select("rec_id", "id", "channel", "text"))
    return s.where("channel = 0").unionByName(s.where("channel = 1"))
