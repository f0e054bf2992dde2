"""Queries that compare transcripts with references, and those over separated tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewords.operators import evaluation as ev
from tidewords.operators import isolation as iso
from tidewords.plans.registry import query
from tidewords.sources import derived as d
from tidewords.sources.shared import settle


@query("s3_read_rttm", f"WITH {d.TURNS_SQL} SELECT 'rec' || rec_id AS rec, start_ms, end_ms, 'spk' || speaker AS speaker FROM turns")
def _(spark, sf_dir):
    t = d.turns(d.words(spark, sf_dir))
    seconds = lambda c: F.format_string("%.3f", c / 1000.0)
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.concat(F.lit("rec"), F.col("rec_id").cast("string")), F.lit("1 "), seconds(F.col("start_ms")), seconds(F.col("end_ms") - F.col("start_ms")), F.lit("<NA> <NA>"), F.concat(F.lit("spk"), F.col("speaker").cast("string")), F.lit("<NA>"))
    other = t.select(F.concat(F.lit("SPKR-INFO rec"), F.col("rec_id").cast("string"), F.lit(" 1 <NA> <NA> <NA> unknown spk <NA>")).alias("line"))
    broken = t.select(F.lit("SPEAKER rec 1 x 1.0 <NA> <NA> spk").alias("line"))
    return ev.read_rttm(t.select(line.alias("line")).unionByName(other).unionByName(broken))[0]


_DER = f"""WITH {d.TURNS_SQL},
rf AS (SELECT rec_id, f, arg_max(speaker, turn_ord) AS ref FROM (SELECT *, unnest(range(start_ms // 10, end_ms // 10)) AS f FROM reference) GROUP BY ALL),
hf AS (SELECT rec_id, f, arg_max(speaker, turn_ord) AS hyp FROM (SELECT *, unnest(range(start_ms // 10, end_ms // 10)) AS f FROM turns) GROUP BY ALL),
near AS (SELECT DISTINCT rec_id, unnest(range(greatest(x - 250, 0) // 10, (x + 250) // 10)) AS f FROM (SELECT rec_id, unnest([start_ms, end_ms]) AS x FROM reference)),
b AS (SELECT coalesce(rf.rec_id, hf.rec_id) AS rec_id, coalesce(rf.f, hf.f) AS f, ref, hyp FROM rf FULL JOIN hf ON rf.rec_id = hf.rec_id AND rf.f = hf.f),
c AS (SELECT rec_id, ref, hyp, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.rec_id = b.rec_id AND near.f = b.f) GROUP BY ALL),
m AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) v(p0, p1, p2)),
best AS (SELECT rec_id, max(s) AS s FROM (SELECT rec_id, p0, p1, p2, coalesce(sum(n) FILTER (hyp = CASE ref WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END), 0) AS s FROM c, m WHERE ref IS NOT NULL AND hyp IS NOT NULL GROUP BY ALL) GROUP BY rec_id),
s AS (SELECT rec_id, sum(n) FILTER (ref IS NOT NULL) AS speech, coalesce(sum(n) FILTER (ref IS NOT NULL AND hyp IS NULL), 0) AS miss, coalesce(sum(n) FILTER (ref IS NULL AND hyp IS NOT NULL), 0) AS fa, coalesce(sum(n) FILTER (ref IS NOT NULL AND hyp IS NOT NULL), 0) AS b FROM c GROUP BY rec_id)
SELECT s.rec_id, CAST(speech AS BIGINT) AS speech, CAST(miss AS BIGINT) AS miss, CAST(fa AS BIGINT) AS false_alarm, CAST(b - coalesce(best.s, 0) AS BIGINT) AS confusion, round((miss + fa + b - coalesce(best.s, 0)) / speech, 9) AS error FROM s LEFT JOIN best USING (rec_id)"""


@query("a16_diarization_error", _DER)
def _(spark, sf_dir):
    w = settle(d.words(spark, sf_dir))
    return ev.diarization_error(d.turns(w, jitter=False), d.turns(w)).withColumn("error", F.round("error", 9))


#: A reference sentence and what was recognised: every fourth word lost and every seventh misheard.
_PAIRS = f"WITH {d.SPOKEN_SQL}, heard AS (SELECT rec_id, id, string_agg(CASE WHEN pos % 7 = 6 THEN 'hm' ELSE word END, ' ' ORDER BY seq) FILTER (pos % 4 <> 3) AS hyp FROM said GROUP BY rec_id, id)"


def _heard(spark, sf_dir):
    w = d.words(spark, sf_dir)
    s = d.spoken(w)
    words = d.spoken_words(w, s).where(F.col("pos") % 4 != 3).withColumn("word", F.when(F.col("pos") % 7 == 6, "hm").otherwise(F.col("word")))
    return s, words


#: Up to 90 different words of a sentence stand for signs, as the edit distance is over bytes. Where more meet, the table of edits is
#: filled diagonal by diagonal: place i of diagonal k is the distance of the first i reference words from the first k - i heard.
@query(
    "a17_word_error_rate",
    _PAIRS.replace("WITH", "WITH RECURSIVE", 1)
    + r""", lists AS (SELECT s.rec_id, s.id, list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda w: regexp_replace(w, '^[\p{P}\p{S}]+|[\p{P}\p{S}]+$', '', 'g')), lambda w: w <> '') AS r, list_filter(list_transform(regexp_split_to_array(lower(coalesce(hyp, '')), '\s+'), lambda w: regexp_replace(w, '^[\p{P}\p{S}]+|[\p{P}\p{S}]+$', '', 'g')), lambda w: w <> '') AS h FROM spoken s LEFT JOIN heard USING (rec_id, id)),
coded AS (SELECT rec_id, id, len(r) AS n, len(h) AS m, array_to_string(list_transform(r, lambda w: chr(33 + list_position(list_distinct(r || h), w)::INT)), '') AS a, array_to_string(list_transform(h, lambda w: chr(33 + list_position(list_distinct(r || h), w)::INT)), '') AS b FROM lists WHERE len(list_distinct(r || h)) <= 90),
diagonal AS (SELECT rec_id, id, r, h, 0::BIGINT AS k, list_transform(range(len(r) + 1), lambda i: CASE WHEN i = 0 THEN 0::BIGINT END) AS p, list_transform(range(len(r) + 1), lambda i: NULL::BIGINT) AS q FROM lists WHERE len(list_distinct(r || h)) > 90
  UNION ALL SELECT rec_id, id, r, h, k + 1, list_transform(range(len(r) + 1), lambda i: CASE WHEN i > k + 1 OR k + 1 - i > len(h) THEN NULL WHEN i = 0 THEN k + 1 WHEN i = k + 1 THEN i ELSE least(p[i] + 1, p[i + 1] + 1, q[i] + (r[i] <> h[k + 1 - i])::BIGINT) END), p FROM diagonal WHERE k < len(r) + len(h)),
told AS (SELECT rec_id, id, n, m, levenshtein(a, b) AS edits FROM coded UNION ALL SELECT rec_id, id, len(r), len(h), p[len(r) + 1] FROM diagonal WHERE k = len(r) + len(h))
SELECT rec_id, id, CAST(n AS INT) AS words, CASE WHEN n > 0 THEN round(edits / n, 9) WHEN m > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS wer FROM told""",
)
def _(spark, sf_dir):
    s, words = _heard(spark, sf_dir)
    hyp = words.groupBy("rec_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"]), " ").alias("hypothesis"))
    pairs = s.join(hyp, ["rec_id", "id"], "left").select("rec_id", "id", F.col("text").alias("reference"), F.coalesce("hypothesis", F.lit("")).alias("hypothesis"))
    return ev.word_error_rate(pairs).select("rec_id", "id", "words", F.round("wer", 9).alias("wer"))


#: What was heard late lacks every ninth word; the walk over both is a recursion, four words ahead at most.
@query(
    "a18_start_drift",
    rf"""WITH RECURSIVE {d.SPOKEN_SQL},
keyed AS (SELECT rec_id, seq, pos, regexp_replace(lower(word), '^[\p{{P}}\p{{S}}]+|[\p{{P}}\p{{S}}]+$', '', 'g') AS w, start_ms FROM said),
b AS (SELECT rec_id, list(w ORDER BY seq) AS w, list(start_ms ORDER BY seq) AS t FROM keyed GROUP BY rec_id),
o AS (SELECT rec_id, list(w ORDER BY seq) AS w, list(start_ms + (13 * pos) % 50 ORDER BY seq) AS t FROM keyed WHERE pos % 9 <> 4 GROUP BY rec_id),
pair AS (SELECT rec_id, b.w AS bw, b.t AS bt, o.w AS ow, o.t AS ot FROM b JOIN o USING (rec_id)),
walk AS (SELECT rec_id, 1::BIGINT AS i, 1::BIGINT AS j, NULL::BIGINT AS far FROM pair
  UNION ALL SELECT rec_id, i + CASE WHEN bw[i] = ow[j] THEN 1 WHEN list_contains(ow[j + 1:j + 3], bw[i]) THEN 0 ELSE 1 END,
    j + CASE WHEN bw[i] = ow[j] THEN 1 WHEN list_contains(ow[j + 1:j + 3], bw[i]) THEN 1 WHEN list_contains(bw[i + 1:i + 3], ow[j]) THEN 0 ELSE 1 END,
    CASE WHEN bw[i] = ow[j] THEN abs(ot[j] - bt[i]) END
  FROM walk JOIN pair USING (rec_id) WHERE i <= len(bw) AND j <= len(ow)),
l AS (SELECT rec_id, list(far ORDER BY far) AS f FROM walk WHERE far IS NOT NULL GROUP BY rec_id)
SELECT rec_id, len(f) AS matched, f[CAST(floor((len(f) - 1) * 0.5) AS BIGINT) + 1] AS median, round(list_avg(f), 6) AS mean, f[CAST(floor((len(f) - 1) * 0.95) AS BIGINT) + 1] AS p95, f[-1] AS most FROM l""",
)
def _(spark, sf_dir):
    w = d.words(spark, sf_dir)
    s = d.spoken(w)
    base = d.spoken_words(w, s)
    other = base.where(F.col("pos") % 9 != 4).withColumn("start_ms", F.col("start_ms") + 13 * F.col("pos") % 50)
    return ev.start_drift(base, other).withColumn("mean", F.round("mean", 6))


#: Words of two tracks: the second hears the first's a little later and more quietly.
_TRACKS = rf"""WITH {d.WORDS_SQL}, tracks AS (SELECT rec_id, 'a' AS track, wid AS seq, word, start_ms, -20.0 - wid % 5 AS db FROM words WHERE role = 'user'
  UNION ALL SELECT rec_id, 'b', wid, CASE WHEN wid % 6 = 5 THEN word || 'x' ELSE word || '!' END, start_ms + 40 * (wid % 17), -22.0 - wid % 3 FROM words WHERE role = 'user'),
keyed AS (SELECT *, lower(regexp_replace(word, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS key FROM tracks),
pairs AS (SELECT a.rec_id, a.seq AS sa, b.seq AS sb, a.start_ms AS xa, a.db AS da, b.db AS db FROM keyed a JOIN keyed b ON a.rec_id = b.rec_id AND a.key = b.key AND a.track = 'a' AND b.track = 'b' AND abs(a.start_ms - b.start_ms) < 500 WHERE a.key <> '')"""


def _tracks(spark, sf_dir):
    w = d.words(spark, sf_dir).where("role = 'user'")
    a = w.select("rec_id", F.lit("a").alias("track"), F.col("wid").alias("seq"), "word", "start_ms", (-20.0 - F.col("wid") % 5).alias("db"))
    heard = F.when(F.col("wid") % 6 == 5, F.concat("word", F.lit("x"))).otherwise(F.concat("word", F.lit("!")))
    return a.unionByName(w.select("rec_id", F.lit("b").alias("track"), F.col("wid").alias("seq"), heard.alias("word"), (F.col("start_ms") + 40 * (F.col("wid") % 17)).alias("start_ms"), (-22.0 - F.col("wid") % 3).alias("db")))


@query("j5_echo_pairs", f"{_TRACKS} SELECT rec_id, sa, sb FROM pairs")
def _(spark, sf_dir):
    return iso.echo_pairs(_tracks(spark, sf_dir)).select("rec_id", F.col("a.seq").alias("sa"), F.col("b.seq").alias("sb"))


@query(
    "j6_drop_echoes",
    f"""{_TRACKS}, o AS (SELECT *, CASE WHEN sa - lag(sa) OVER w <= 1 AND sb - lag(sb) OVER w <= 1 AND xa - lag(xa) OVER w <= 1000 THEN 0 ELSE 1 END AS o FROM pairs WINDOW w AS (PARTITION BY rec_id ORDER BY sa, sb)),
g AS (SELECT *, sum(o) OVER (PARTITION BY rec_id ORDER BY sa, sb) AS run FROM o), r AS (SELECT rec_id, run, count(*) AS n, avg(da) AS la, avg(db) AS lb FROM g GROUP BY ALL)
SELECT DISTINCT g.rec_id, CASE WHEN la > lb THEN 'b' ELSE 'a' END AS track, CASE WHEN la > lb THEN sb ELSE sa END AS seq FROM g JOIN r USING (rec_id, run) WHERE n > 1 OR abs(la - lb) >= 3""",
)
def _(spark, sf_dir):
    return iso.echoes(_tracks(spark, sf_dir))


#: A signal of 64 samples, 20 ms each, is both recording and (sixteen times quieter on a third of it) track.
_LEVELS = f"""WITH {d.SAMPLES_SQL}, w AS (SELECT rec_id, idx // 4 AS wid, min(idx) * 20 AS a, (max(idx) + 1) * 20 AS b FROM samples GROUP BY ALL),
l AS (SELECT w.rec_id, w.wid, 10 * log10(avg(v * v) + 1e-12) AS rec_db, 10 * log10(avg(CASE WHEN idx % 24 < 8 THEN v * v / 4096 ELSE v * v END) + 1e-12) AS own_db FROM w JOIN samples s ON s.rec_id = w.rec_id AND s.idx * 20 >= w.a AND (s.idx + 1) * 20 <= greatest(w.b, w.a + 80) GROUP BY ALL)"""


@query("j4_drop_leaks", f"{_LEVELS} SELECT rec_id, wid FROM l WHERE rec_db >= -70 AND own_db - rec_db < -25")
def _(spark, sf_dir):
    s = d.samples(spark, sf_dir)
    words = s.groupBy("rec_id", F.floor(F.col("idx") / 4).alias("wid")).agg((F.min("idx") * 20).alias("start_ms"), ((F.max("idx") + 1) * 20).alias("end_ms"))
    track = s.withColumn("v", F.when(F.col("idx") % 24 < 8, F.col("v") / 64).otherwise(F.col("v")))
    own = iso.levels(words, track, ["rec_id"], 20).withColumnRenamed("db", "own_db")
    return iso.leaks(iso.levels(own, s, ["rec_id"], 20).withColumnRenamed("db", "rec_db")).select("rec_id", "wid")


_DROPS = f"WITH {d.SPOKEN_SQL}, marked AS (SELECT *, length(word) % 5 = 0 OR id % 11 = 3 AS gone FROM said)"


def _pruned(spark, sf_dir):
    w = d.words(spark, sf_dir)
    s = d.spoken(w)
    words = d.spoken_words(w, s)
    return iso.prune(s.select("rec_id", "id", "start_ms", "end_ms", "text"), words, words.where((F.length("word") % 5 == 0) | (F.col("id") % 11 == 3)))


@query("j7_prune_words", f"{_DROPS}, k AS (SELECT rec_id, id, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY seq) FILTER (NOT gone) AS t, arg_min(start_ms, seq) FILTER (NOT gone) AS a, arg_max(end_ms, seq) FILTER (NOT gone) AS b FROM marked GROUP BY rec_id, id) SELECT p.rec_id, p.id, CASE WHEN g > 0 THEN a ELSE start_ms END AS start_ms, CASE WHEN g > 0 THEN b ELSE end_ms END AS end_ms, CASE WHEN g > 0 THEN t ELSE text END AS text FROM spoken p JOIN k USING (rec_id, id) WHERE t IS NOT NULL")
def _(spark, sf_dir):
    return _pruned(spark, sf_dir)[0]


@query("j7_dropped_words", f"{_DROPS} SELECT rec_id, count(*) FILTER (gone) AS dropped, CASE WHEN count(*) FILTER (gone) > 0 THEN 'isolation_leaks_dropped' END AS warning FROM marked GROUP BY rec_id")
def _(spark, sf_dir):
    return _pruned(spark, sf_dir)[1]


_VOICES = f"WITH {d.SPOKEN_SQL}, segs AS (SELECT rec_id, coalesce(speaker, 'spk_2') AS speaker, id AS ord, start_ms, end_ms, CASE WHEN n_words = 1 THEN '  ' ELSE ' ' || text END AS text FROM spoken), voices AS (SELECT DISTINCT rec_id, unnest(['spk_1', 'spk_0', 'spk_2', 'spk_3']) AS speaker, unnest([0, 1, 2, 3]) AS voice FROM spoken), tot AS (SELECT rec_id, max(end_ms) + 1000 AS total, 7 * count(*) AS ms FROM spoken GROUP BY rec_id), kept AS (SELECT s.*, v.voice FROM segs s JOIN voices v ON v.rec_id = s.rec_id AND v.speaker = s.speaker WHERE trim(text) <> '')"


def _voices(spark, sf_dir):
    s = settle(d.spoken(d.words(spark, sf_dir)))
    segs = s.select("rec_id", F.coalesce("speaker", F.lit("spk_2")).alias("speaker"), F.col("id").alias("ord"), "start_ms", "end_ms", F.when(F.col("n_words") == 1, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"))
    voices = s.select("rec_id").distinct().select("rec_id", F.posexplode(F.array(*map(F.lit, ("spk_1", "spk_0", "spk_2", "spk_3")))).alias("ord", "speaker"))
    totals = s.groupBy("rec_id").agg((F.max("end_ms") + 1000).alias("total"), (7 * F.count("*")).alias("processing_ms"))
    return voices, segs, totals


@query("a9_merged_segments", f"{_VOICES} SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, voice, ord) - 1 AS id, speaker, 0 AS channel, start_ms, end_ms, trim(text) AS text FROM kept")
def _(spark, sf_dir):
    return iso.merge_tracks(*_voices(spark, sf_dir))[0]


@query("a9_merged_speakers", f"{_VOICES} SELECT DISTINCT s.rec_id, v.voice, s.speaker, coalesce(round((SELECT sum(end_ms - start_ms) FROM kept k WHERE k.rec_id = s.rec_id AND k.speaker = s.speaker) / 1000, 2), 0.0) AS total_speech, (SELECT count(*) FROM kept k WHERE k.rec_id = s.rec_id AND k.speaker = s.speaker) AS segments FROM segs s JOIN voices v ON v.rec_id = s.rec_id AND v.speaker = s.speaker")
def _(spark, sf_dir):
    return iso.merge_tracks(*_voices(spark, sf_dir))[1]


@query("a9_merged_recordings", f"{_VOICES}, c AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM kept), r AS (SELECT rec_id, sum(greatest(end_ms - greatest(cur, start_ms), 0)) AS speech FROM c GROUP BY rec_id), t AS (SELECT rec_id, string_agg(trim(text), ' ' ORDER BY start_ms, voice, ord) AS text, count(*) AS segments FROM kept GROUP BY rec_id) SELECT rec_id, text, segments, round(least(1.0, speech / total), 2) AS speech_ratio, round(ms / total, 9) AS rtf FROM tot JOIN r USING (rec_id) JOIN t USING (rec_id)")
def _(spark, sf_dir):
    return iso.merge_tracks(*_voices(spark, sf_dir))[2].withColumn("rtf", F.round("rtf", 9))


@query("j16_missing_voices", f"{_VOICES} SELECT rec_id, 'isolation_voices_missing' AS code, 'not in the transcript, for want of a track: ' || string_agg(speaker, ', ' ORDER BY voice) AS message FROM voices v WHERE NOT EXISTS (SELECT 1 FROM segs s WHERE s.rec_id = v.rec_id AND s.speaker = v.speaker) GROUP BY rec_id")
def _(spark, sf_dir):
    voices, segs, _totals = _voices(spark, sf_dir)
    return iso.missing_voices(voices, segs)
