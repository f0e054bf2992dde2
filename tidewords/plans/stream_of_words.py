"""Queries over tokens and word streams, and the scalar functions applied to them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewords.functions import scalar as f
from tidewords.operators import wordstream as ws
from tidewords.plans.registry import query
from tidewords.sources import derived as d


def _tokens(spark, sf_dir):
    """Tokens of a turn as one segment, with special tokens put in and no durations."""
    t = d.tokens(d.words(spark, sf_dir))
    k = F.row_number().over(Window.partitionBy("rec_id", "turn").orderBy("wid", "k")) - 1
    seg = F.max("end_ms").over(Window.partitionBy("rec_id", "turn"))
    special = F.when(F.pmod("wid", F.lit(29)) == 0, F.lit("<unk>")).otherwise(F.col("token"))
    return t.select("rec_id", "turn", k.alias("k"), special.alias("token"), "ts_ms", F.lit(0).cast("long").alias("dur_ms"), (-F.col("conf_milli") / 1000).alias("logprob"), seg.alias("seg_ms"))


_ASSEMBLED = f"""{d.TOKENS_SQL},
tk AS (SELECT rec_id, turn, row_number() OVER p - 1 AS k, CASE WHEN wid % 29 = 0 THEN '<unk>' ELSE token END AS token, ts_ms, -conf_milli / 1000 AS lp, max(end_ms) OVER (PARTITION BY rec_id, turn) AS seg
  FROM tokens WINDOW p AS (PARTITION BY rec_id, turn ORDER BY wid, k)),
tn AS (SELECT *, coalesce(lead(ts_ms) OVER (PARTITION BY rec_id, turn ORDER BY k), seg) AS te FROM tk),
tg AS (SELECT *, sum(CASE WHEN token LIKE '▁%' OR token LIKE ' %' THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, turn ORDER BY k) AS w FROM tn WHERE NOT (ltrim(token, '▁') LIKE '<%' AND token LIKE '%>')),
made AS (SELECT rec_id, turn, trim(string_agg(replace(token, '▁', ''), '' ORDER BY k)) AS word, least(greatest(arg_min(ts_ms, k), 0), max(seg)) AS start_ms, greatest(least(greatest(arg_max(te, k), 0), max(seg)), least(greatest(arg_min(ts_ms, k), 0), max(seg))) AS end_ms, exp(avg(lp)) AS conf, min(k) AS k
  FROM tg GROUP BY rec_id, turn, w HAVING trim(string_agg(replace(token, '▁', ''), '' ORDER BY k)) <> '')"""


@query("w1_assemble_words", f"WITH {_ASSEMBLED} SELECT rec_id, turn, k, word, start_ms, end_ms, round(conf, 9) AS conf FROM made")
def w1(spark, sf_dir):
    return ws.assemble_words(_tokens(spark, sf_dir), ["rec_id", "turn"]).select("rec_id", "turn", "k", "word", "start_ms", "end_ms", F.round("conf", 9).alias("conf"))


@query("a5_word_confidence", f"WITH {d.TOKENS_SQL} SELECT rec_id, wid, round(exp(avg(-conf_milli / 1000)), 9) AS conf FROM tokens GROUP BY ALL")
def a5(spark, sf_dir):
    return d.tokens(d.words(spark, sf_dir)).groupBy("rec_id", "wid").agg(F.round(F.exp(F.avg(-F.col("conf_milli") / 1000)), 9).alias("conf"))


_MARKS = r"""parted AS (SELECT rec_id, turn, wid * 2 + j AS k, CASE WHEN j = 0 THEN regexp_replace(word, '[.,!?]+$', '') ELSE regexp_extract(word, '[.,!?]+$') END AS word, CASE WHEN j = 0 THEN start_ms ELSE end_ms - 10 END AS start_ms, end_ms + 15 * j AS end_ms FROM words, (VALUES (0), (1)) v(j)),
pw AS (SELECT * FROM parted WHERE word <> '')"""


def _parted(spark, sf_dir):
    """Words with their closing marks as words of their own."""
    w = d.words(spark, sf_dir).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when(F.col("j") == 0, F.regexp_replace("word", "[.,!?]+$", "")).otherwise(F.regexp_extract("word", "[.,!?]+$", 0))
    start = F.when(F.col("j") == 0, F.col("start_ms")).otherwise(F.col("end_ms") - 10)
    return w.select("rec_id", "turn", (F.col("wid") * 2 + F.col("j")).alias("k"), text.alias("word"), start.alias("start_ms"), (F.col("end_ms") + 15 * F.col("j")).alias("end_ms")).where("word <> ''")


@query("w2_merge_punctuation", rf"WITH {d.WORDS_SQL}, {_MARKS}, g AS (SELECT *, sum(CASE WHEN regexp_full_match(word, '[\p{{P}}\p{{S}}]+') AND r > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, turn ORDER BY k) AS i FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, turn ORDER BY k) AS r FROM pw)) SELECT rec_id, turn, min(k) AS k, string_agg(word, '' ORDER BY k) AS word, arg_min(start_ms, k) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY rec_id, turn, i")
def w2(spark, sf_dir):
    return ws.merge_punctuation(_parted(spark, sf_dir), ["rec_id", "turn"], "k")


@query("w3_enforce_monotonic", f"WITH {d.WORDS_SQL}, {_MARKS} SELECT rec_id, turn, k, start_ms, CASE WHEN n IS NULL THEN end_ms ELSE greatest(least(end_ms, n), start_ms) END AS end_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY rec_id, turn ORDER BY k) AS n FROM pw)")
def w3(spark, sf_dir):
    return ws.enforce_monotonic(_parted(spark, sf_dir), ["rec_id", "turn"], "k").select("rec_id", "turn", "k", "start_ms", "end_ms")


@query(
    "w9_retime_segments",
    f"""WITH RECURSIVE {d.SEGMENTS_SQL},
s AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY turn, sn) AS i, start_ms, end_ms FROM segments),
r AS (SELECT rec_id, i, start_ms, end_ms FROM s WHERE i = 1
  UNION ALL SELECT s.rec_id, s.i, greatest(s.start_ms, r.end_ms), greatest(s.end_ms, greatest(s.start_ms, r.end_ms)) FROM r JOIN s ON s.rec_id = r.rec_id AND s.i = r.i + 1)
SELECT rec_id, i, start_ms, end_ms FROM r""",
)
def w9(spark, sf_dir):
    w = d.words(spark, sf_dir)
    s = d.segments(w).withColumn("i", F.row_number().over(Window.partitionBy("rec_id").orderBy("turn", "sn")))
    narrow = s.withColumn("start_ms", F.col("start_ms") + 40).withColumn("end_ms", F.col("end_ms") - 40)
    before = F.coalesce(F.sum(F.when(F.substring("word", -1, 1).isin(*d.SENTENCE_END), 1).otherwise(0)).over(Window.partitionBy("rec_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ws.retime(narrow, w.withColumn("sn", before).select("rec_id", "turn", "sn", "wid", "start_ms", "end_ms"), ["rec_id", "turn", "sn"], "i").select("rec_id", "i", "start_ms", "end_ms")


@query("w22_chunks_with_overlap", f"WITH {d.WORDS_SQL}, n AS (SELECT rec_id, max(wid) AS last FROM words GROUP BY rec_id), c AS (SELECT rec_id, unnest(range(0, last // 200 + 1)) AS chunk FROM n) SELECT w.rec_id, chunk, wid, wid >= 200 * chunk AS owned FROM words w JOIN c ON w.rec_id = c.rec_id AND wid >= 200 * chunk - 20 AND wid < 200 * chunk + 200")
def w22(spark, sf_dir):
    return ws.chunks_with_overlap(d.words(spark, sf_dir), ["rec_id"], "wid")


@query("w26_merge_channels", f"WITH {d.SEGMENTS_SQL} SELECT rec_id, channel, turn, sn, start_ms, end_ms, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, channel, turn, sn) - 1 AS id FROM segments")
def w26(spark, sf_dir):
    s = d.segments(d.words(spark, sf_dir))
    return ws.merge_channels(s.where("channel = 0").unionByName(s.where("channel = 1"))).select("rec_id", "channel", "turn", "sn", "start_ms", "end_ms", "id")


_ASKED = "asked AS (SELECT DISTINCT rec_id, CAST(start_ms + 137 * (wid % 7) - 200 AS BIGINT) AS t FROM words)"


def _asked(w):
    return w.select("rec_id", (F.col("start_ms") + 137 * (F.col("wid") % 7) - 200).cast("long").alias("t")).distinct()


@query("j11_word_at", f"WITH {d.WORDS_SQL}, {_ASKED}, c AS (SELECT a.rec_id, a.t, w.wid, w.end_ms, row_number() OVER (PARTITION BY a.rec_id, a.t ORDER BY w.start_ms DESC, w.wid DESC) AS r FROM asked a LEFT JOIN words w ON w.rec_id = a.rec_id AND w.start_ms - 10 <= a.t) SELECT rec_id, t, coalesce(CASE WHEN t <= end_ms + 10 THEN wid END, -1) AS wid FROM c WHERE r = 1")
def j11(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return ws.words_at(w, _asked(w))


@query("j12_neighbour_words", f"WITH {d.WORDS_SQL}, {_ASKED} SELECT rec_id, t, coalesce((SELECT w.wid FROM words w WHERE w.rec_id = asked.rec_id AND w.start_ms < t - 1 ORDER BY w.start_ms DESC, w.wid DESC LIMIT 1), -1) AS previous, coalesce((SELECT w.wid FROM words w WHERE w.rec_id = asked.rec_id AND w.start_ms > t + 1 ORDER BY w.start_ms, w.wid LIMIT 1), -1) AS next FROM asked")
def j12(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return ws.neighbours(w, _asked(w))


@query("j13_current_words", f"WITH {d.WORDS_SQL}, {_ASKED}, c AS (SELECT a.rec_id, a.t, w.role, w.wid, w.end_ms, row_number() OVER (PARTITION BY a.rec_id, a.t, w.role ORDER BY w.start_ms DESC, w.wid DESC) AS r FROM asked a JOIN words w ON w.rec_id = a.rec_id AND w.start_ms - 10 <= a.t) SELECT rec_id, t, role, wid FROM c WHERE r = 1 AND t <= end_ms + 300")
def j13(spark, sf_dir):
    w = d.words(spark, sf_dir)
    who = w.select("rec_id", "role").distinct()
    found = ws.asof_last(w.withColumn("s", F.col("start_ms") - 10), _asked(w).join(who, "rec_id").select("rec_id", "role", "t"), ["rec_id", "role"], "s", "t", ["wid", "end_ms"], "wid")
    return found.where("t <= end_ms + 300").select("rec_id", "t", "role", "wid")


@query("p4_word_flags", f"WITH {d.WORDS_SQL} SELECT rec_id, wid, contains(lower(word), 'th') AS hit, conf_milli > 0 AND conf_milli < 500 AS low FROM words WHERE role = 'user'")
def p4(spark, sf_dir):
    w = d.words(spark, sf_dir)
    needle = F.lower(F.trim(F.lit(" TH ")))
    return w.where("role = 'user'").select("rec_id", "wid", F.lower("word").contains(needle).alias("hit"), ((F.col("conf_milli") > 0) & (F.col("conf_milli") < 500)).alias("low"))


@query("p8_drop_special_tokens", f"WITH {_ASSEMBLED} SELECT rec_id, turn, k FROM tk WHERE NOT (ltrim(token, '▁') LIKE '<%' AND token LIKE '%>')")
def p8(spark, sf_dir):
    return _tokens(spark, sf_dir).where(~f.is_special_token(F.col("token"))).select("rec_id", "turn", "k")


@query("p9_is_punctuation", rf"WITH {d.WORDS_SQL}, {_MARKS} SELECT rec_id, k, regexp_full_match(word, '[\p{{P}}\p{{S}}]+') AS mark FROM pw")
def p9(spark, sf_dir):
    return _parted(spark, sf_dir).select("rec_id", "k", f.is_punctuation(F.col("word")).alias("mark"))


@query("p12_missing_confidence", f"WITH {d.WORDS_SQL} SELECT rec_id, turn, count(*) > 0 AND coalesce(max(conf_milli), 0) <= 0 AS missing FROM words WHERE length(word) > 9 GROUP BY ALL")
def p12(spark, sf_dir):
    return d.words(spark, sf_dir).where("length(word) > 9").groupBy("rec_id", "turn").agg(((F.count("*") > 0) & (F.coalesce(F.max("conf_milli"), F.lit(0)) <= 0)).alias("missing"))


@query("a22_vocabulary_punctuates", f"WITH {d.TOKENS_SQL} SELECT rec_id, bool_or(token IN ('.', '?', '!')) AS marks, bool_or(regexp_matches(token, '\\p{{Lu}}')) AS upper FROM tokens GROUP BY rec_id".replace("\\\\", "\\"))
def a22(spark, sf_dir):
    return d.tokens(d.words(spark, sf_dir)).groupBy("rec_id").agg(F.bool_or(F.col("token").isin(".", "?", "!")).alias("marks"), F.bool_or(F.col("token").rlike(r"\p{Lu}")).alias("upper"))


_SEC_SQL = "(start_ms / 1000 + 0.0005)"


def _sec():
    return F.col("start_ms") / 1000 + 0.0005


#: Scalar functions over words: a Column, and the same in SQL.
_SCALARS = {
    "f1_timecode_trunc": (lambda: f.timecode_trunc(_sec()), "printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)".replace("{x}", f"CAST(floor({_SEC_SQL} * 1000) AS BIGINT)")),
    "f2_timecode_even": (lambda: f.timecode_even(_sec(), ".", False), "CASE WHEN {x} >= 3600000 THEN printf('%02d:%02d:%02d.%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000) ELSE printf('%02d:%02d.%03d', {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000) END".replace("{x}", f"CAST(round_even({_SEC_SQL} * 1000, 0) AS BIGINT)")),
    "f3_millis": (lambda: f.millis(_sec() - 1), f"CASE WHEN {_SEC_SQL} - 1 <= 0 THEN 0 ELSE CAST(round_even(({_SEC_SQL} - 1) * 1000, 0) AS BIGINT) END"),
    "f5_clock": (lambda: f.clock(_sec() * 60), "CASE WHEN {x} >= 3600 THEN printf('%d:%02d:%02d', {x} // 3600, {x} // 60 % 60, {x} % 60) ELSE printf('%d:%02d', {x} // 60, {x} % 60) END".replace("{x}", f"CAST(floor({_SEC_SQL} * 60) AS BIGINT)")),
    "f4_milli_round": (lambda: f.milli_round(F.col("start_ms") / 8192), "round(start_ms / 8192, 3)"),
    "f4_round2": (lambda: f.round2(F.col("start_ms") / 8192), "round(start_ms / 8192, 2)"),
    "f7_base_id": (lambda: f.base_id(f.model_key(F.col("word"), F.col("role"))), "word"),
    "f8_speaker_name": (lambda: f.speaker_name_clean(F.repeat(F.concat(F.lit(" \t"), "word"), 6)), r"CASE WHEN length(trim(regexp_replace(repeat(' ' || chr(9) || word, 6), '\p{Cc}', '', 'g'))) <= 64 THEN trim(regexp_replace(repeat(' ' || chr(9) || word, 6), '\p{Cc}', '', 'g')) END".replace("\\\\", "\\")),
    "f9_result_name": (lambda: f.result_name(F.concat(F.lit("/a.b/"), F.col("word"), F.lit('?x.tar.gz'))), "word || '_x.tar-voice'"),
    "f14_share": (lambda: F.round(f.share(F.col("start_ms"), F.col("end_ms") - 300), 9), "CASE WHEN end_ms > 300 THEN round(least(1.0, start_ms / (end_ms - 300)), 9) ELSE 0.0 END"),
    "f14_clamp": (lambda: f.clamp(F.col("start_ms"), F.lit(1000), F.lit(9000)), "least(greatest(start_ms, 1000), 9000)"),
    "f14_joins": (lambda: f.joins(F.col("end_ms"), F.col("start_ms") + 137 * (F.col("wid") % 7)), "start_ms + 137 * (wid % 7) - end_ms <= 350"),
    "f11_text_delta_other": (lambda: f.text_delta(F.substring("word", 2, 1), F.col("word")), "CASE WHEN substr(word, 2, 1) = '' THEN word WHEN starts_with(word, substr(word, 2, 1)) THEN substr(word, 2) ELSE '' END"),
    "f16_bad_cursor": (lambda: f.cursor_decode(F.when(F.col("wid") % 3 == 0, F.col("word")).when(F.col("wid") % 3 == 1, F.lit("A")).otherwise(F.lit("eDp5")))["id"].isNull(), "true"),
    "f7_base_tag": (lambda: f.base_tag(F.concat("role", F.lit("-"), "word")), "role"),
    "f9_file_safe": (lambda: f.file_safe(F.concat("word", F.lit('/a:b?'))), "word || '_a_b_'"),
    "f10_word_key": (lambda: f.word_key(F.col("word")), r"lower(regexp_replace(word, '[^\p{L}\p{Nd}]', '', 'g'))"),
    "f11_text_delta": (lambda: f.text_delta(F.substring("word", 1, 2), F.col("word")), "CASE WHEN substr(word, 1, 2) = '' THEN word ELSE substr(word, 3) END"),
    "f14_overlap": (lambda: f.overlap(F.col("start_ms"), F.col("end_ms"), F.col("start_ms") + 150, F.col("end_ms") + 50), "greatest(end_ms - start_ms - 150, 0)"),
    "f16_cursor": (lambda: f.cursor_decode(f.cursor_encode(F.col("start_ms"), F.col("word")))["id"], "word"),
    "f17_variant_key": (lambda: f.variant_key(F.col("role"), F.col("word")), "substr(sha256(CAST(strlen(role) AS VARCHAR)::BLOB || '\\x00'::BLOB || role::BLOB || CAST(strlen(word) AS VARCHAR)::BLOB || '\\x00'::BLOB || encode(word)), 1, 12)"),
    "f18_trim_punct": (lambda: F.concat_ws("|", *f.trim_punct(F.col("word"))), "regexp_replace(word, '[.,!?;:]+$', '') || '|' || regexp_extract(word, '[.,!?;:]+$')"),
    "f22_stage_percent": (lambda: f.stage_percent(F.element_at(F.array(F.lit("decode"), F.lit("vad"), F.lit("asr"), F.lit("post")), (F.col("wid") % 4 + 1).cast("int"))), "[10, 25, 40, 0][wid % 4 + 1]"),
    "f23_logprob": (lambda: F.round(f.logprob(F.col("conf_milli") / 1000), 9), "CASE WHEN conf_milli > 0 THEN round(ln(conf_milli / 1000), 9) ELSE 0.0 END"),
    "f24_model_key": (lambda: f.model_key(F.col("role"), F.when(F.col("wid") % 2 == 0, F.col("word"))), "CASE WHEN wid % 2 = 0 THEN role || '@' || word ELSE role END"),
    "f27_timeline_percent": (lambda: F.round(f.timeline_percent(F.col("start_ms") - 500, F.col("end_ms")), 6), "round(least(greatest((start_ms - 500) / end_ms * 100, 0.0), 100.0), 6)"),
}


def _register(name, column, sql):
    @query(name, f"WITH {d.WORDS_SQL} SELECT rec_id, wid, {sql} AS value FROM words")
    def run(spark, sf_dir):
        return d.words(spark, sf_dir).select("rec_id", "wid", column().alias("value"))


for _name, (_column, _sql) in _SCALARS.items():
    _register(_name, _column, _sql)


@query("f6_human_bytes", "SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 10240 THEN printf('%.1f KB', round(b / 1024, 1)) WHEN b < 1048576 THEN printf('%d KB', CAST(round(b / 1024) AS BIGINT)) ELSE printf('%.1f MB', round(b / 1048576, 1)) END AS value FROM (SELECT doc_id, strlen(text) * 40 AS b FROM documents)")
def f6(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", f.human_bytes(F.octet_length("text") * 40).alias("value"))
