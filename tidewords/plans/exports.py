"""Queries over transcripts as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewords.operators import exporters as op
from tidewords.operators import spans
from tidewords.plans.registry import query
from tidewords.sources import derived as d
from tidewords.sources.shared import settle

_SPOKEN = f"WITH {d.SPOKEN_SQL}"
_CODE = "printf('%02d:%02d:%02d{m}%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"
_SHORT = "CASE WHEN {c} >= 3600000 THEN printf('%02d:%02d:%02d.%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000) ELSE printf('%02d:%02d.%03d', {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000) END"


def _code(column: str, mark: str) -> str:
    return _CODE.replace("{m}", mark).replace("{c}", column)


def _segments(spark, sf_dir):
    return d.spoken(d.words(spark, sf_dir))


def _both(spark, sf_dir):
    w = d.words(spark, sf_dir)
    s = d.spoken(w)
    return s, d.spoken_words(w, s)


@query("s8_write_txt", f"{_SPOKEN} SELECT rec_id, id AS n, CASE WHEN speaker IS NULL THEN '' ELSE '[' || speaker || ']: ' END || trim(text) AS line FROM spoken")
def _(spark, sf_dir):
    return op.text_lines(_segments(spark, sf_dir))


@query("s9_write_srt", f"{_SPOKEN} SELECT rec_id, id + 1 AS n, (id + 1) || chr(10) || {_code('start_ms', ',')} || ' --> ' || {_code('end_ms', ',')} || chr(10) || CASE WHEN speaker IS NULL THEN '' ELSE speaker || ': ' END || text || chr(10) AS line FROM spoken")
def _(spark, sf_dir):
    return op.srt(_segments(spark, sf_dir))


@query("s10_write_vtt", f"{_SPOKEN} SELECT rec_id, id + 1 AS n, {_code('start_ms', '.')} || ' --> ' || {_code('end_ms', '.')} || chr(10) || CASE WHEN speaker IS NULL THEN text ELSE '<v ' || speaker || '>' || text || '</v>' END || chr(10) AS line FROM spoken UNION ALL SELECT DISTINCT rec_id, 0, 'WEBVTT' || chr(10) FROM spoken")
def _(spark, sf_dir):
    return op.vtt(_segments(spark, sf_dir))


@query("s12_write_tsv", f"{_SPOKEN} SELECT rec_id, id + 1 AS n, start_ms || chr(9) || end_ms || chr(9) || replace(trim(text), chr(9), ' ') AS line FROM spoken UNION ALL SELECT DISTINCT rec_id, 0, concat_ws(chr(9), 'start', 'end', 'text') FROM spoken")
def _(spark, sf_dir):
    return op.tsv(_segments(spark, sf_dir))


@query("s15_write_text", f"{_SPOKEN}, t AS (SELECT rec_id, string_agg(trim(text), ' ' ORDER BY id) AS text FROM spoken WHERE trim(text) <> '' GROUP BY rec_id) SELECT rec_id, text, CAST(to_json({{'text': text}}) AS VARCHAR) AS json FROM t")
def _(spark, sf_dir):
    return op.plain_text(_segments(spark, sf_dir))


@query("s16_write_dialogue", f"{_SPOKEN}, w AS (SELECT *, coalesce(speaker, '') AS who FROM spoken WHERE trim(text) <> ''), o AS (SELECT *, CASE WHEN lag(who) OVER (PARTITION BY rec_id ORDER BY id) IS DISTINCT FROM who THEN 1 ELSE 0 END AS o FROM w), g AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY id) AS n FROM o) SELECT rec_id, CAST(n AS BIGINT) AS n, CASE WHEN who = '' THEN '' ELSE who || ': ' END || string_agg(trim(text), ' ' ORDER BY id) AS line FROM g GROUP BY rec_id, n, who")
def _(spark, sf_dir):
    return op.dialogue(_segments(spark, sf_dir))


#: Lines by stepping from word to word: characters on the line, number of the line and of the cue.
_CUES = f"""WITH RECURSIVE {d.SPOKEN_SQL},
walk AS (SELECT rec_id, seq, start_ms, length(word) AS room, 1 AS line, 1 AS cue, true AS opens FROM said WHERE seq = 0
  UNION ALL SELECT s.rec_id, s.seq, s.start_ms,
    CASE WHEN s.start_ms - w.start_ms > 3000 OR w.room + length(s.word) > 1000 THEN length(s.word) ELSE w.room + length(s.word) END,
    CASE WHEN s.start_ms - w.start_ms > 3000 OR w.room + length(s.word) > 1000 AND w.line = 2 THEN 1 WHEN w.room + length(s.word) > 1000 THEN 2 ELSE w.line END,
    CASE WHEN s.start_ms - w.start_ms > 3000 OR w.room + length(s.word) > 1000 AND w.line = 2 THEN w.cue + 1 ELSE w.cue END,
    s.start_ms - w.start_ms > 3000 OR w.room + length(s.word) > 1000
  FROM walk w JOIN said s ON s.rec_id = w.rec_id AND s.seq = w.seq + 1),
cues AS (SELECT w.rec_id, w.cue, min(s.start_ms) AS start_ms, max(s.end_ms) AS end_ms, CASE WHEN arg_min(coalesce(s.speaker, ''), s.seq) = '' THEN '' ELSE '[' || arg_min(coalesce(s.speaker, ''), s.seq) || ']: ' END || string_agg(CASE WHEN w.opens AND w.line = 2 THEN chr(10) ELSE '' END || s.word, ' ' ORDER BY s.seq) AS text
  FROM walk w JOIN said s ON s.rec_id = w.rec_id AND s.seq = w.seq GROUP BY w.rec_id, w.cue)"""


@query("w18_cue_groups", f"{_CUES} SELECT rec_id, seq, CAST(cue AS BIGINT) AS cue, line - 1 AS row FROM walk")
def _(spark, sf_dir):
    return op.cue_lines(_both(spark, sf_dir)[1]).select("rec_id", "seq", "cue", F.col("row").cast("int").alias("row"))


@query("s11_write_cue_srt", f"{_CUES} SELECT rec_id, CAST(cue AS BIGINT) AS n, cue || chr(10) || {_code('start_ms', ',')} || ' --> ' || {_code('end_ms', ',')} || chr(10) || text || chr(10) AS line FROM cues")
def _(spark, sf_dir):
    s, w = _both(spark, sf_dir)
    return op.cue_srt(op.all_cues(w, s))


@query("s11_write_cue_vtt", f"{_CUES} SELECT rec_id, CAST(cue AS BIGINT) AS n, {_SHORT.replace('{c}', 'start_ms')} || ' --> ' || {_SHORT.replace('{c}', 'end_ms')} || chr(10) || text || chr(10) AS line FROM cues UNION ALL SELECT DISTINCT rec_id, 0, 'WEBVTT' || chr(10) FROM cues")
def _(spark, sf_dir):
    s, w = _both(spark, sf_dir)
    return op.cue_vtt(op.all_cues(w, s))


@query("f25_cue_join", f"{_SPOKEN} SELECT rec_id, id, string_agg(word, '' ORDER BY seq) AS ja, string_agg(word, ' ' ORDER BY seq) AS en FROM said GROUP BY rec_id, id")
def _(spark, sf_dir):
    ws = F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"])
    return _both(spark, sf_dir)[1].groupBy("rec_id", "id").agg(op.cue_join(ws, "ja-JP").alias("ja"), op.cue_join(ws, "en").alias("en"))


_JSON_WORD = "'word': word, 'start': start_ms / 1000, 'end': end_ms / 1000, 'score': conf_milli / 1000"
_JSON_SEGMENT = "'start': p.start_ms / 1000, 'end': p.end_ms / 1000, 'text': trim(p.text), 'words': ws"


@query(
    "s13_write_word_json",
    f"{_SPOKEN}, w AS (SELECT rec_id, id, list(CASE WHEN speaker IS NULL THEN to_json({{{_JSON_WORD}}}) ELSE to_json({{{_JSON_WORD}, 'speaker': speaker}}) END ORDER BY seq) AS ws FROM said GROUP BY rec_id, id) SELECT rec_id, id, CAST(CASE WHEN speaker IS NULL THEN to_json({{{_JSON_SEGMENT}}}) ELSE to_json({{{_JSON_SEGMENT}, 'speaker': speaker}}) END AS VARCHAR) AS segment FROM spoken p JOIN w USING (rec_id, id)",
)
def _(spark, sf_dir):
    return op.word_json(*_both(spark, sf_dir))


@query("s14_verbose_segments", f"{_SPOKEN} SELECT rec_id, id, start_ms // 10 AS seek, start_ms, end_ms, text, speaker, CASE WHEN avg_conf > 0 THEN round(ln(avg_conf), 9) ELSE 0.0 END AS avg_logprob FROM spoken")
def _(spark, sf_dir):
    return op.verbose_segments(_segments(spark, sf_dir)).withColumn("avg_logprob", F.round("avg_logprob", 9))


@query("s14_verbose_words", f"{_SPOKEN} SELECT s.rec_id, s.seq, s.word, p.speaker FROM said s JOIN spoken p USING (rec_id, id)")
def _(spark, sf_dir):
    s, w = _both(spark, sf_dir)
    own = w.withColumn("speaker", F.when(F.col("channel") == 1, F.col("speaker")))
    return op.verbose_words(own, s).select("rec_id", "seq", "word", "speaker")


#: Recordings with what a server told of them: some have warnings, and two more have no segments.
_TOLD = f"""{_SPOKEN}, ends AS (SELECT rec_id, max(end_ms) + 1000 AS total FROM spoken GROUP BY rec_id),
rec AS (SELECT rec_id, total FROM ends UNION ALL SELECT -rec_id - 1, 5000 FROM ends WHERE rec_id < 2),
told AS (SELECT rec_id, 'm' || abs(rec_id) % 3 AS model, CASE WHEN rec_id % 4 <> 0 THEN 'en' END AS language, 'token' AS timestamp_source, total, total // 4 AS processing_ms, total // 10 AS decode, total // 20 AS asr,
  CASE WHEN rec_id < 0 THEN [{{'code': 'no_speech_detected', 'message': 'no speech'}}] WHEN rec_id % 5 = 0 THEN [{{'code': 'itn_unavailable', 'message': 'none for "x"'}}, {{'code': 'late', 'message': 'é'}}] ELSE [] END AS warnings FROM rec),
gapped AS (SELECT rec_id, cur AS s, start_ms AS e FROM (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM (SELECT rec_id, start_ms, end_ms FROM spoken UNION ALL SELECT rec_id, total, total FROM ends)) WHERE start_ms > cur)"""


def _results(spark, sf_dir):
    s, w = _both(spark, sf_dir)
    s = s.withColumn("avg_conf", F.round("avg_conf", 6))
    ends = s.groupBy("rec_id").agg((F.max("end_ms") + 1000).alias("total"))
    gaps = spans.transcript_silences(s, ends)
    rec = ends.unionByName(ends.where("rec_id < 2").select((-F.col("rec_id") - 1).alias("rec_id"), F.lit(5000).cast("long").alias("total")))
    warn = lambda code, message: F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"))
    warnings = F.when(F.col("rec_id") < 0, F.array(warn("no_speech_detected", "no speech"))).when(F.col("rec_id") % 5 == 0, F.array(warn("itn_unavailable", 'none for "x"'), warn("late", "é"))).otherwise(F.array().cast(op.WARNINGS))
    part = lambda n: F.floor(F.col("total") / n)
    stages = F.create_map(F.lit("decode"), part(10), F.lit("asr"), part(20))
    told = rec.select("rec_id", F.concat(F.lit("m"), F.abs("rec_id") % 3).alias("model"), F.when(F.col("rec_id") % 4 != 0, "en").alias("language"), F.lit("token").alias("timestamp_source"), F.col("total").alias("duration_ms"), part(4).alias("processing_ms"), stages.alias("stages_ms"), warnings.alias("warnings"))
    return op.result_json(told, s, w, gaps)


_RESULT_WORD = "'word': word, 'start': start_ms / 1000, 'end': end_ms / 1000, 'confidence': conf_milli / 1000"
_RESULT_SEGMENT = "'id': id, 'start': p.start_ms / 1000, 'end': p.end_ms / 1000, 'text': p.text, 'channel': p.channel"


@query(
    "s20_write_result_json",
    _TOLD
    + f""", w AS (SELECT rec_id, id, list(CASE WHEN speaker IS NULL THEN to_json({{{_RESULT_WORD}, 'channel': channel}}) ELSE to_json({{{_RESULT_WORD}, 'speaker': speaker, 'channel': channel}}) END ORDER BY seq) AS words FROM said GROUP BY rec_id, id),
seg AS (SELECT p.rec_id, list(CASE WHEN speaker IS NULL THEN to_json({{{_RESULT_SEGMENT}, 'avg_confidence': round(avg_conf, 6), 'words': words}}) ELSE to_json({{{_RESULT_SEGMENT}, 'speaker': speaker, 'avg_confidence': round(avg_conf, 6), 'words': words}}) END ORDER BY id) AS segments, string_agg(trim(text), ' ' ORDER BY id) AS text FROM spoken p JOIN w USING (rec_id, id) GROUP BY p.rec_id),
sil AS (SELECT rec_id, list({{'start': s / 1000, 'end': e / 1000}} ORDER BY s) AS silence, sum(e - s) AS quiet FROM gapped GROUP BY rec_id),
spk AS (SELECT rec_id, list({{'id': speaker, 'total_speech': ms / 1000, 'segments': n}} ORDER BY speaker) AS speakers FROM (SELECT rec_id, speaker, sum(end_ms - start_ms)::BIGINT AS ms, count(*) AS n FROM spoken WHERE speaker IS NOT NULL GROUP BY ALL) GROUP BY rec_id)
SELECT rec_id, '{{"id":' || rec_id || ',"model":"' || model || '"' || CASE WHEN language IS NULL THEN '' ELSE ',"language":"' || language || '"' END || ',"duration":' || to_json(total / 1000) || ',"text":' || to_json(coalesce(text, '')) || ',"timestamp_source":"token","segments":' || coalesce(to_json(segments), '[]') || ',"silence":' || coalesce(to_json(silence), '[]')
  || CASE WHEN speakers IS NULL THEN '' ELSE ',"speakers":' || to_json(speakers) END || ',"stats":' || to_json({{'audio_duration': total / 1000, 'processing_ms': processing_ms, 'rtf': round(processing_ms / total, 6), 'stages_ms': {{'decode': decode, 'asr': asr}}, 'segments_total': coalesce(len(segments), 0), 'speech_ratio': CASE WHEN segments IS NULL THEN 0.0::DOUBLE ELSE round((total - coalesce(quiet, 0)) / total, 6) END}})
  || CASE WHEN len(warnings) = 0 THEN '' ELSE ',"warnings":' || to_json(warnings) END || '}}' AS result FROM told LEFT JOIN seg USING (rec_id) LEFT JOIN sil USING (rec_id) LEFT JOIN spk USING (rec_id)""",
)
def _(spark, sf_dir):
    return _results(spark, sf_dir)


@query("s13_word_document", f"{_SPOKEN}, w AS (SELECT rec_id, id, seq, CASE WHEN speaker IS NULL THEN to_json({{{_JSON_WORD}}}) ELSE to_json({{{_JSON_WORD}, 'speaker': speaker}}) END AS j FROM said), ws AS (SELECT rec_id, id, list(j ORDER BY seq) AS ws FROM w GROUP BY ALL), flat AS (SELECT rec_id, list(j ORDER BY id, seq) AS f FROM w GROUP BY ALL), seg AS (SELECT p.rec_id, list(CASE WHEN speaker IS NULL THEN to_json({{{_JSON_SEGMENT}}}) ELSE to_json({{{_JSON_SEGMENT}, 'speaker': speaker}}) END ORDER BY id) AS s FROM spoken p JOIN ws USING (rec_id, id) GROUP BY p.rec_id) SELECT rec_id, '{{\"segments\":' || to_json(s) || ',\"word_segments\":' || to_json(f) || ',\"language\":\"en\"}}' AS document FROM seg JOIN flat USING (rec_id)")
def _(spark, sf_dir):
    s, w = _both(spark, sf_dir)
    return op.word_document(s, w, s.select("rec_id", F.lit("en").alias("language")).distinct())


@query("s1_read_recordings", f"{_TOLD} SELECT t.rec_id, model, language, total AS duration_ms, CAST((SELECT count(*) FROM spoken s WHERE s.rec_id = t.rec_id) AS INT) AS n_segments, processing_ms, decode FROM told t")
def _(spark, sf_dir):
    whole = op.read_summaries(_results(spark, sf_dir))[0]
    return whole.select("rec_id", "model", "language", "duration_ms", "n_segments", "processing_ms", F.col("stages_ms")["decode"].alias("decode"))


@query("s1_read_speakers", f"{_SPOKEN} SELECT rec_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, count(*) AS segments FROM spoken WHERE speaker IS NOT NULL GROUP BY ALL")
def _(spark, sf_dir):
    return op.read_summaries(_results(spark, sf_dir))[1]


@query("s1_read_warnings", f"{_TOLD} SELECT rec_id, CAST(generate_subscripts(warnings, 1) - 1 AS INT) AS ord, unnest(warnings).code AS code, unnest(warnings).message AS message FROM told")
def _(spark, sf_dir):
    return op.read_summaries(_results(spark, sf_dir))[2]


@query("s1_read_words", f"{_SPOKEN} SELECT rec_id, id, seq, word, start_ms, end_ms, CAST(conf_milli AS BIGINT) AS conf_milli, speaker, channel FROM said")
def _(spark, sf_dir):
    return op.read_transcripts(_results(spark, sf_dir))[0]


@query("s1_read_segments", f"{_SPOKEN} SELECT rec_id, id, channel, speaker, start_ms, end_ms, text, round(avg_conf, 6) AS avg_conf FROM spoken")
def _(spark, sf_dir):
    return op.read_transcripts(_results(spark, sf_dir))[1].withColumn("avg_conf", F.round("avg_conf", 9))


@query("s1_read_silence", f"{_SPOKEN}, t AS (SELECT rec_id, max(end_ms) + 1000 AS total FROM spoken GROUP BY rec_id), a AS (SELECT rec_id, start_ms, end_ms FROM spoken UNION ALL SELECT rec_id, total, total FROM t), c AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM a) SELECT rec_id, cur AS start_ms, start_ms AS end_ms FROM c WHERE start_ms > cur")
def _(spark, sf_dir):
    return op.read_transcripts(_results(spark, sf_dir))[2]
