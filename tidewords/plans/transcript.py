"""Queries over words, spans, turns and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewords.functions import intervals
from tidewords.operators import hooks
from tidewords.operators import signals as sig
from tidewords.operators import speakers as sp
from tidewords.operators import spans as op
from tidewords.plans.registry import ORACLES, query
from tidewords.sources import derived as d
from tidewords.sources.shared import settle

ATTRIBUTED_SQL = (
    d.TURNS_SQL
    + """,
over AS (SELECT w.rec_id, w.wid, t.speaker, row_number() OVER (PARTITION BY w.rec_id, w.wid ORDER BY least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms) DESC, t.turn_ord) AS r,
    least(1.0, (least(w.end_ms, t.end_ms) - greatest(w.start_ms, t.start_ms)) / (w.end_ms - w.start_ms)) AS c
  FROM words w JOIN {turns} t ON w.rec_id = t.rec_id AND least(w.end_ms, t.end_ms) > greatest(w.start_ms, t.start_ms)),
near AS (SELECT w.rec_id, w.wid, t.speaker, row_number() OVER (PARTITION BY w.rec_id, w.wid
    ORDER BY greatest(2 * t.start_ms - w.start_ms - w.end_ms, w.start_ms + w.end_ms - 2 * t.end_ms, 0), t.turn_ord) AS r
  FROM words w JOIN {turns} t ON w.rec_id = t.rec_id WHERE NOT EXISTS (SELECT 1 FROM over o WHERE o.rec_id = w.rec_id AND o.wid = w.wid)),
found AS (SELECT rec_id, wid, speaker, c AS speaker_conf FROM over WHERE r = 1 UNION ALL SELECT rec_id, wid, speaker, 0.3 FROM near WHERE r = 1),
attributed AS (SELECT w.*, f.speaker, f.speaker_conf FROM words w LEFT JOIN found f ON w.rec_id = f.rec_id AND w.wid = f.wid)"""
).replace("{turns}", "turns")
#: Turns cut short on both sides, so that words fall between turns.
_SHORT = "(SELECT rec_id, turn_ord, speaker, start_ms + 700 AS start_ms, greatest(start_ms + 800, end_ms - 900) AS end_ms FROM turns)"
GAPPED_SQL = ATTRIBUTED_SQL.replace("JOIN turns t", f"JOIN {_SHORT} t")
SPLIT_SQL = (
    d.SEGMENTS_SQL
    + ATTRIBUTED_SQL.removeprefix(d.WORDS_SQL)
    + """,
sw AS (SELECT *, coalesce(sum(CASE WHEN right(word, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sn FROM attributed),
r0 AS (SELECT *, CASE WHEN row_number() OVER k = 1 OR speaker IS DISTINCT FROM lag(speaker) OVER k THEN 1 ELSE 0 END AS o FROM sw WINDOW k AS (PARTITION BY rec_id, turn, sn ORDER BY pos)),
r1 AS (SELECT *, sum(o) OVER (PARTITION BY rec_id, turn, sn ORDER BY pos) AS run FROM r0),
runs AS (SELECT rec_id, turn, sn, run, count(*) AS n, arg_min(start_ms, pos) AS a, arg_max(end_ms, pos) AS b, any_value(speaker) AS who FROM r1 GROUP BY ALL),
kept AS (SELECT *, (n >= 2 AND b - a >= 500) OR run = 1 AS k FROM runs),
prev AS (SELECT *, (SELECT arg_max(who, q.run) FROM kept q WHERE q.rec_id = p.rec_id AND q.turn = p.turn AND q.sn = p.sn AND q.run < p.run AND q.k) AS held FROM kept p),
grp AS (SELECT *, sum(CASE WHEN run = 1 OR (k AND who IS DISTINCT FROM held) THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, turn, sn ORDER BY run) AS g FROM prev),
first AS (SELECT rec_id, turn, sn, max(g) AS top, sum(n) FILTER (g = 1) AS n1, min(a) FILTER (g = 1) AS a1, max(b) FILTER (g = 1) AS b1 FROM grp GROUP BY ALL),
grouped AS (SELECT grp.*, CASE WHEN top > 1 AND NOT (n1 >= 2 AND b1 - a1 >= 500) THEN greatest(g - 1, 1) ELSE g END - 1 AS part FROM grp JOIN first USING (rec_id, turn, sn)),
gw AS (SELECT r1.*, part FROM r1 JOIN grouped USING (rec_id, turn, sn, run)),
votes AS (SELECT rec_id, turn, sn, part, speaker, sum(greatest(end_ms - start_ms, 0) + 10) AS t FROM gw WHERE speaker IS NOT NULL GROUP BY ALL),
who AS (SELECT rec_id, turn, sn, part, speaker FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, turn, sn, part ORDER BY t DESC, speaker) AS r FROM votes) WHERE r = 1),
parts AS (SELECT rec_id, turn, sn, part, arg_min(start_ms, pos) AS a, arg_max(end_ms, pos) AS b, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM gw GROUP BY rec_id, turn, sn, part),
split AS (SELECT p.rec_id, p.turn, p.sn, CAST(p.part AS BIGINT) AS part, w.speaker, CASE WHEN p.part = 0 THEN s.start_ms ELSE a END AS start_ms, CASE WHEN p.part = max(p.part) OVER (PARTITION BY p.rec_id, p.turn, p.sn) THEN s.end_ms ELSE b END AS end_ms, n AS n_words, p.text
  FROM parts p JOIN segments s USING (rec_id, turn, sn) LEFT JOIN who w ON w.rec_id = p.rec_id AND w.turn = p.turn AND w.sn = p.sn AND w.part = p.part)"""
)


def _spans(words: DataFrame) -> DataFrame:
    return words.select("rec_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))


def _totals(words: DataFrame) -> DataFrame:
    return words.groupBy("rec_id").agg((F.max("end_ms") + 1000).alias("total"))


def _attributed(spark, sf_dir, gapped=False) -> DataFrame:
    w = settle(d.words(spark, sf_dir))
    return sp.attribute(w, settle(_gapped(d.turns(w)) if gapped else d.turns(w)))


def _gapped(turns: DataFrame) -> DataFrame:
    """Turns cut short on both sides, so that words fall between them."""
    return turns.withColumns({"start_ms": F.col("start_ms") + 700, "end_ms": F.greatest(F.col("start_ms") + 800, F.col("end_ms") - 900)})


def _sentences(words: DataFrame) -> DataFrame:
    """Words with the number of their sentence in the turn."""
    ended = F.when(F.substring("word", -1, 1).isin(*d.SENTENCE_END), 1).otherwise(0)
    at = Window.partitionBy("rec_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("sn", F.coalesce(F.sum(ended).over(at), F.lit(0)))


def split(spark, sf_dir) -> DataFrame:
    w = settle(_sentences(_attributed(spark, sf_dir)))
    return sp.split_segments(d.segments(w), w, ["rec_id", "turn", "sn"], "pos")


@query("w4_merge_spans", f"WITH {d.WORDS_SQL}, o AS (SELECT *, CASE WHEN start_ms > max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM words WHERE end_ms > start_ms), g AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms) AS i FROM o) SELECT rec_id, min(start_ms) AS s, max(end_ms) AS e FROM g GROUP BY rec_id, i")
def w4(spark, sf_dir):
    return op.merge_spans(_spans(d.words(spark, sf_dir)))


@query("w5_silences", f"WITH {d.WORDS_SQL}, a AS (SELECT rec_id, start_ms, end_ms FROM words UNION ALL SELECT rec_id, max(end_ms) + 1000, max(end_ms) + 1000 FROM words GROUP BY rec_id), c AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM a) SELECT rec_id, cur AS start_ms, start_ms AS end_ms FROM c WHERE start_ms - cur >= 300")
def w5(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return op.silences(_spans(w), _totals(w))


@query("w5b_transcript_silences", f"WITH {d.WORDS_SQL}, t AS (SELECT rec_id, max(end_ms) + 1000 AS total FROM words GROUP BY rec_id), a AS (SELECT rec_id, start_ms, end_ms FROM words UNION ALL SELECT rec_id, total, total FROM t), c AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM a), r AS (SELECT rec_id, sum(greatest(end_ms - greatest(cur, start_ms), 0)) AS speech FROM c GROUP BY rec_id) SELECT rec_id, cur AS start_ms, start_ms AS end_ms, round(least(1.0, speech / total), 2) AS speech_ratio FROM c JOIN r USING (rec_id) JOIN t USING (rec_id) WHERE start_ms > cur")
def w5b(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return op.transcript_silences(w, _totals(w))


_CUT = """cuts AS (SELECT a.rec_id, a.speaker, a.turn_ord, a.start_ms AS s, a.end_ms AS e, b.start_ms AS bs, b.end_ms AS be FROM turns a LEFT JOIN turns b ON b.rec_id = a.rec_id AND b.speaker <> a.speaker AND b.start_ms < a.end_ms AND b.end_ms > a.start_ms WHERE a.end_ms > a.start_ms),
edges AS (SELECT DISTINCT rec_id, speaker, x FROM (SELECT rec_id, speaker, unnest([start_ms, end_ms]) AS x FROM turns UNION ALL SELECT a.rec_id, a.speaker, unnest([b.start_ms, b.end_ms]) FROM (SELECT DISTINCT rec_id, speaker FROM turns) a JOIN turns b ON b.rec_id = a.rec_id)),
bits AS (SELECT rec_id, speaker, x AS s, lead(x) OVER (PARTITION BY rec_id, speaker ORDER BY x) AS e FROM edges),
own AS (SELECT * FROM bits b WHERE e > s AND EXISTS (SELECT 1 FROM turns t WHERE t.rec_id = b.rec_id AND t.speaker = b.speaker AND t.start_ms <= b.s AND t.end_ms >= b.e) AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.rec_id = b.rec_id AND t.speaker <> b.speaker AND t.start_ms <= b.s AND t.end_ms >= b.e)),
marked AS (SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY rec_id, speaker ORDER BY s) THEN 0 ELSE 1 END AS o FROM own),
grouped AS (SELECT *, sum(o) OVER (PARTITION BY rec_id, speaker ORDER BY s) AS g FROM marked)"""


@query("w6_subtract_spans", f"WITH {d.TURNS_SQL}, {_CUT} SELECT rec_id, speaker, min(s) AS s, max(e) AS e FROM grouped GROUP BY rec_id, speaker, g")
def w6(spark, sf_dir):
    """Each speaker's time in which no other speaks."""
    t = settle(d.turns(d.words(spark, sf_dir)).select("rec_id", "speaker", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    who = t.select("rec_id", F.col("speaker").alias("me")).distinct()
    key = F.struct("rec_id", "me")
    own = t.select(F.struct("rec_id", F.col("speaker").alias("me")).alias("rec_id"), "s", "e")
    others = t.join(who, "rec_id").where("me <> speaker").select(key.alias("rec_id"), "s", "e")
    return op.merge_spans(op.subtract_spans(own, others)).select("rec_id.rec_id", F.col("rec_id.me").alias("speaker"), "s", "e")


@query("w6_coverage", f"WITH {d.TURNS_SQL}, win AS (SELECT rec_id, unnest(range(0, last, 3000)) AS ws FROM (SELECT rec_id, max(end_ms) AS last FROM words GROUP BY rec_id)) SELECT rec_id, ws, ws + 3000 AS we, CAST((SELECT coalesce(sum(greatest(0, least(t.end_ms, ws + 3000) - greatest(t.start_ms, ws))), 0) FROM turns t WHERE t.rec_id = win.rec_id) AS BIGINT) AS covered FROM win")
def w6c(spark, sf_dir):
    w = settle(d.words(spark, sf_dir))
    win = w.groupBy("rec_id").agg(F.max("end_ms").alias("last")).select("rec_id", F.explode(F.expr("sequence(0L, last - 1, 3000L)")).alias("ws")).withColumn("we", F.col("ws") + 3000)
    return op.coverage(win, d.turns(w).select("rec_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))


@query("j1_assign_speakers", f"WITH {ATTRIBUTED_SQL} SELECT rec_id, wid, speaker, c AS confidence FROM over WHERE r = 1")
def j1(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return sp.assign_speakers(w, d.turns(w))


@query("j2_nearest_turn", f"WITH {GAPPED_SQL} SELECT rec_id, wid, speaker, speaker_conf FROM attributed")
def j2(spark, sf_dir):
    return _attributed(spark, sf_dir, gapped=True).select("rec_id", "wid", "speaker", "speaker_conf")


@query("j3_attribution_guard", f"WITH {d.TURNS_SQL}, ok AS (SELECT DISTINCT w.rec_id, w.wid FROM words w JOIN {_SHORT} t ON w.rec_id = t.rec_id AND least(w.end_ms, t.end_ms) > greatest(w.start_ms, t.start_ms)), m AS (SELECT rec_id, count(*) AS m FROM ok GROUP BY rec_id), n AS (SELECT rec_id, count(*) AS n FROM words GROUP BY rec_id) SELECT rec_id, n AS n_words, coalesce(m, 0) AS n_attributed, CASE WHEN n <> coalesce(m, 0) THEN 'diarization_unavailable' END AS warning FROM n LEFT JOIN m USING (rec_id)")
def j3(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return sp.guard_attribution(w, sp.assign_speakers(w, _gapped(d.turns(w))))


@query("w8_split_segments", f"WITH {SPLIT_SQL} SELECT * FROM split")
def w8(spark, sf_dir):
    return split(spark, sf_dir)


@query("w7_speaker_runs", f"WITH {SPLIT_SQL} SELECT rec_id, wid, CAST(part AS BIGINT) AS part FROM gw")
def w7(spark, sf_dir):
    return sp.speaker_runs(_sentences(_attributed(spark, sf_dir)), ["rec_id", "turn", "sn"], "pos").select("rec_id", "wid", F.col("group").alias("part"))


@query("a1_speaker_summary", f"WITH {SPLIT_SQL} SELECT rec_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, count(*) AS segments FROM split WHERE speaker IS NOT NULL GROUP BY ALL")
def a1(spark, sf_dir):
    return sp.speaker_summary(split(spark, sf_dir))


@query("a2_dominant_speaker", f"WITH {ATTRIBUTED_SQL}, v AS (SELECT rec_id, turn, speaker, sum(greatest(end_ms - start_ms, 0) + 10) AS t FROM attributed WHERE speaker IS NOT NULL GROUP BY ALL) SELECT DISTINCT rec_id, turn, first_value(speaker) OVER (PARTITION BY rec_id, turn ORDER BY t DESC, speaker) AS speaker FROM v")
def a2(spark, sf_dir):
    return sp.dominant_speaker(_attributed(spark, sf_dir), ["rec_id", "turn"])


@query("a3_avg_confidence", f"WITH {d.WORDS_SQL} SELECT rec_id, turn, coalesce(avg(nullif(conf_milli, 0)), 0.0) AS avg_conf FROM words GROUP BY ALL")
def a3(spark, sf_dir):
    return sp.average_confidence(d.words(spark, sf_dir), ["rec_id", "turn"])


@query("w14_renumber", f"WITH {d.TURNS_SQL}, f AS (SELECT rec_id, speaker, min(start_ms) AS f FROM turns GROUP BY ALL), n AS (SELECT rec_id, speaker, row_number() OVER (PARTITION BY rec_id ORDER BY f, speaker) - 1 AS number FROM f) SELECT rec_id, turn_ord, start_ms, end_ms, number AS speaker FROM turns JOIN n USING (rec_id, speaker)")
def w14(spark, sf_dir):
    return sp.renumber_by_first_appearance(d.turns(d.words(spark, sf_dir)))


@query("a24_voice_table", f"WITH {d.TURNS_SQL}, f AS (SELECT rec_id, speaker, min(start_ms) AS f, count(*) AS turns, sum(end_ms - start_ms) AS ms FROM turns WHERE end_ms > start_ms GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY f, speaker) - 1 AS number FROM f) SELECT rec_id, number AS speaker, turns, round(ms / 1000, 2) AS seconds, row_number() OVER (PARTITION BY rec_id ORDER BY ms DESC, number) AS rank FROM n")
def a24(spark, sf_dir):
    return sp.voice_table(d.turns(d.words(spark, sf_dir)))


@query("l5_voices_by_speech", f"WITH {d.TURNS_SQL} SELECT rec_id, speaker, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms, row_number() OVER (PARTITION BY rec_id ORDER BY sum(end_ms - start_ms) DESC, min(start_ms), speaker) AS rank FROM turns GROUP BY rec_id, speaker")
def l5(spark, sf_dir):
    sums = d.turns(d.words(spark, sf_dir)).groupBy("rec_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.min("start_ms").alias("f"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("rec_id").orderBy(F.desc("ms"), "f", "speaker"))).drop("f")


@query("p13_drop_tiny_speakers", f"WITH {d.TURNS_SQL}, s AS (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY rec_id, speaker) AS mine, sum(end_ms - start_ms) OVER (PARTITION BY rec_id) AS al FROM turns) SELECT rec_id, turn_ord, speaker, start_ms, end_ms FROM s WHERE mine >= 0.35 * al")
def p13(spark, sf_dir):
    return sp.drop_tiny_speakers(d.turns(d.words(spark, sf_dir)), 0.35)


@query("u3_distinct_speakers", f"WITH {ATTRIBUTED_SQL} SELECT rec_id, count(DISTINCT speaker) AS speakers FROM attributed GROUP BY rec_id")
def u3(spark, sf_dir):
    return _attributed(spark, sf_dir).groupBy("rec_id").agg(F.count_distinct("speaker").alias("speakers"))


@query("l4_longest_k", f"WITH {d.WORDS_SQL} SELECT rec_id, wid, start_ms, end_ms FROM words QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY end_ms - start_ms DESC, wid) <= 24")
def l4(spark, sf_dir):
    from tidewords.operators.patterns import first_k

    return first_k(d.words(spark, sf_dir).select("rec_id", "wid", "start_ms", "end_ms"), ["rec_id"], [F.desc(F.col("end_ms") - F.col("start_ms")), "wid"], 24)


@query("l6_spread", f"WITH {d.WORDS_SQL}, n AS (SELECT rec_id, count(*) AS n FROM words GROUP BY rec_id), w AS (SELECT DISTINCT rec_id, unnest(list_transform(range(0, 24), lambda i: i * n // 24)) AS wid FROM n) SELECT rec_id, wid, word FROM words JOIN w USING (rec_id, wid)")
def l6(spark, sf_dir):
    return op.spread(d.words(spark, sf_dir).select("rec_id", "wid", "word"), ["rec_id"], ["wid"], 24)


@query("w21_isolation_regions", f"WITH {d.WORDS_SQL}, t AS (SELECT rec_id, max(end_ms) + 1000 AS total FROM words GROUP BY rec_id), o AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 500 THEN 1 ELSE 0 END AS n FROM words WHERE channel = 1), g AS (SELECT *, sum(n) OVER (PARTITION BY rec_id ORDER BY start_ms, end_ms) AS i FROM o), k AS (SELECT rec_id, min(start_ms) AS s, max(end_ms) AS e FROM g GROUP BY rec_id, i), edges AS (SELECT rec_id, s AS x FROM k UNION SELECT rec_id, e FROM k UNION SELECT rec_id, 0 FROM t UNION SELECT rec_id, total FROM t), r AS (SELECT rec_id, x AS s, lead(x) OVER (PARTITION BY rec_id ORDER BY x) AS e FROM edges) SELECT r.rec_id, r.s, r.e, k.s IS NOT NULL AS kept, greatest(r.s - 500, 0) AS feed FROM r LEFT JOIN k ON k.rec_id = r.rec_id AND k.s = r.s WHERE r.e > r.s")
def w21(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return op.isolation_regions(_spans(w.where("channel = 1")), _totals(w))


#: The assistant speaks half a second earlier still, so that turns overlap.
_CONVERSATION = f"""WITH {d.SEGMENTS_SQL}, early AS (SELECT rec_id, channel, turn, sn, role, n_words, text, greatest(start_ms - 500 * channel, 0) AS start_ms, greatest(end_ms - 500 * channel, 1) AS end_ms FROM segments), s AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, channel, turn, sn) - 1 AS ord, role AS speaker, start_ms, end_ms, n_words FROM early),
r AS (SELECT *, sum(CASE WHEN speaker IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY ord) AS run FROM (SELECT *, lag(speaker) OVER (PARTITION BY rec_id ORDER BY ord) AS p FROM s)),
l AS (SELECT *, start_ms - max(end_ms) OVER (PARTITION BY rec_id, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM r),
t AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3000 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY ord) AS turn,
  EXISTS (SELECT 1 FROM s o WHERE o.rec_id = l.rec_id AND o.ord < l.ord AND o.speaker <> l.speaker AND o.end_ms > l.start_ms + 200) AS busy FROM l)
"""


@query("w16_conversation_turns", _CONVERSATION + "SELECT rec_id, CAST(turn AS BIGINT) AS turn, arg_min(speaker, ord) AS speaker, arg_min(start_ms, ord) AS start_ms, max(end_ms) AS end_ms, count(*) AS segments, arg_min(busy, ord) AS overlaps FROM t GROUP BY rec_id, turn")
def w16(spark, sf_dir):
    return sp.conversation_turns(_early(spark, sf_dir))


def _early(spark, sf_dir) -> DataFrame:
    early = lambda c, least: F.greatest(F.col(c) - 500 * F.col("channel"), F.lit(least))
    s = d.segments(d.words(spark, sf_dir)).withColumns({"start_ms": early("start_ms", 0), "end_ms": early("end_ms", 1)})
    ord_ = F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms", "channel", "turn", "sn")) - 1
    return settle(s.select("rec_id", ord_.alias("ord"), F.col("role").alias("speaker"), "start_ms", "end_ms", "n_words", "text"))


@query("j20_overlapping_turns", _CONVERSATION + "SELECT rec_id, CAST(turn AS BIGINT) AS turn FROM t GROUP BY rec_id, turn HAVING arg_min(busy, ord)")
def j20(spark, sf_dir):
    return w16(spark, sf_dir).where("overlaps").select("rec_id", "turn")


@query("a4_speaker_shares", _CONVERSATION + """, turns AS (SELECT rec_id, turn, arg_min(speaker, ord) AS speaker FROM t GROUP BY rec_id, turn),
listed AS (SELECT DISTINCT rec_id, unnest(['user', 'assistant', 'system', 'nobody']) AS speaker FROM s), p AS (SELECT rec_id, speaker, CAST(sum(greatest(end_ms - start_ms, 0)) AS BIGINT) AS ms, CAST(sum(n_words) AS BIGINT) AS n FROM s GROUP BY ALL),
c AS (SELECT rec_id, speaker, count(*) AS k FROM turns GROUP BY ALL), m AS (SELECT l.rec_id, l.speaker, coalesce(ms, 0) AS spoken_ms, coalesce(n, 0) AS words, coalesce(k, 0) AS turns FROM listed l LEFT JOIN p ON p.rec_id = l.rec_id AND p.speaker = l.speaker LEFT JOIN c ON c.rec_id = l.rec_id AND c.speaker = l.speaker)
SELECT *, round(spoken_ms / sum(spoken_ms) OVER (PARTITION BY rec_id), 6) AS share FROM m""")
def a4(spark, sf_dir):
    s = _early(spark, sf_dir)
    listed = s.select("rec_id").distinct().withColumn("speaker", F.explode(F.array(*map(F.lit, ("user", "assistant", "system", "nobody")))))
    spoken = s.groupBy("rec_id", "speaker").agg(F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("ms"))
    speakers = listed.join(spoken, ["rec_id", "speaker"], "left").select("rec_id", "speaker", F.coalesce("ms", F.lit(0)).cast("long").alias("total_ms"))
    return sp.speaker_shares(s, sp.conversation_turns(s), speakers).withColumn("share", F.round("share", 6))


@query("j8_name_speakers", f"WITH {d.SPOKEN_SQL} SELECT rec_id, id, CASE WHEN speaker = 'spk_0' THEN 'Ann ' || rec_id ELSE speaker END AS speaker FROM spoken")
def j8(spark, sf_dir):
    s = d.spoken(d.words(spark, sf_dir))
    name = F.when(F.col("speaker") == "spk_0", F.concat(F.lit(" Ann "), F.col("rec_id").cast("string"))).otherwise(F.lit("  "))
    names = s.select("rec_id", "speaker").distinct().select("rec_id", "speaker", name.alias("name"))
    return sp.name_speakers(s, names).select("rec_id", "id", "speaker")


_RENAMES = rf"WITH {d.SPOKEN_SQL}, jobs AS (SELECT rec_id, CASE WHEN max(end_ms) > 90000 THEN 'succeeded' ELSE 'running' END AS status FROM spoken GROUP BY rec_id), own AS (SELECT DISTINCT rec_id, speaker FROM spoken WHERE speaker IS NOT NULL), asked AS (SELECT conv_id + 1 AS rec_id, CASE WHEN role = 'system' THEN 'spk_1' ELSE 'spk_' || turn END AS speaker, substr(text, 1, 10 + 9 * turn) AS name FROM conversations), judged AS (SELECT a.*, CASE WHEN j.rec_id IS NULL THEN 'no such job' WHEN j.status <> 'succeeded' THEN 'not finished' WHEN o.rec_id IS NULL THEN 'no such speaker' WHEN length(trim(regexp_replace(name, '\p{{Cc}}', '', 'g'))) > 64 THEN 'long name' END AS reason FROM asked a LEFT JOIN jobs j ON j.rec_id = a.rec_id LEFT JOIN own o ON o.rec_id = a.rec_id AND o.speaker = a.speaker)"


def _renames(spark, sf_dir):
    s = settle(d.spoken(d.words(spark, sf_dir)))
    jobs = s.groupBy("rec_id").agg(F.when(F.max("end_ms") > 90000, "succeeded").otherwise("running").alias("status"))
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = c.select((F.col("conv_id") + 1).alias("rec_id"), F.when(F.col("role") == "system", "spk_1").otherwise(F.concat(F.lit("spk_"), F.col("turn").cast("string"))).alias("speaker"), F.expr("substring(text, 1, cast(10 + 9 * turn as int))").alias("name"))
    return sp.rename_speakers(jobs, s.where("speaker IS NOT NULL"), asked)


@query("j8_renames", _RENAMES + r" SELECT rec_id, speaker, trim(regexp_replace(name, '\p{Cc}', '', 'g')) AS name FROM judged WHERE reason IS NULL")
def j8r(spark, sf_dir):
    return _renames(spark, sf_dir)[0]


@query("j8_refused_renames", _RENAMES + " SELECT rec_id, speaker, name, reason FROM judged WHERE reason IS NOT NULL")
def j8x(spark, sf_dir):
    return _renames(spark, sf_dir)[1]


@query(
    "w10_frames_to_turns",
    f"""WITH {d.SAMPLES_SQL}, f AS (SELECT rec_id // 4 AS rec_id, rec_id % 4 AS speaker, idx AS frame, v FROM samples), r AS (SELECT *, frame - row_number() OVER (PARTITION BY rec_id, speaker ORDER BY frame) AS run FROM f WHERE frame < 60 AND v > 0),
t AS (SELECT rec_id, speaker, min(frame) * 10 AS start_ms, least((max(frame) + 1) * 10, 595) AS end_ms FROM r GROUP BY rec_id, speaker, run), n AS (SELECT rec_id, speaker, row_number() OVER (PARTITION BY rec_id ORDER BY min(start_ms), speaker) - 1 AS number FROM t GROUP BY rec_id, speaker)
SELECT t.rec_id, row_number() OVER (PARTITION BY t.rec_id ORDER BY start_ms, t.speaker) - 1 AS turn_ord, number AS speaker, start_ms, end_ms FROM t JOIN n ON n.rec_id = t.rec_id AND n.speaker = t.speaker""",
)
def w10(spark, sf_dir):
    x = d.samples(spark, sf_dir).select(F.floor(F.col("rec_id") / 4).alias("rec_id"), (F.col("rec_id") % 4).alias("speaker"), F.col("idx").alias("frame"), F.col("v").alias("logit"))
    return sp.frames_to_turns(x, x.select("rec_id").distinct().select("rec_id", F.lit(60).alias("valid"), F.lit(595).cast("long").alias("duration_ms")))


_FREE = f"""WITH {d.TURNS_SQL}, tot AS (SELECT rec_id, max(end_ms) + 1000 AS total FROM words GROUP BY rec_id), who AS (SELECT DISTINCT rec_id, speaker AS me FROM turns),
h AS (SELECT t.rec_id, speaker, greatest(start_ms, 0) AS s, least(end_ms, total) AS e, total FROM turns t JOIN tot USING (rec_id)),
b AS (SELECT h.rec_id, me, greatest(s - 150, 0) AS s, least(e + 150, total) AS e FROM h JOIN who ON who.rec_id = h.rec_id AND me <> speaker),
c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY rec_id, me ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM (SELECT * FROM b UNION ALL SELECT rec_id, me, total, total FROM who JOIN tot USING (rec_id))),
free AS (SELECT rec_id, me, cur AS fs, s AS fe FROM c WHERE s > cur),
o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY rec_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM h WHERE e > s), g AS (SELECT *, sum(n) OVER (PARTITION BY rec_id, speaker ORDER BY s, e) AS i FROM o),
own AS (SELECT rec_id, speaker AS me, min(s) AS s, max(e) AS e FROM g GROUP BY rec_id, speaker, i),
clean AS (SELECT who.rec_id, who.me, CAST(coalesce((SELECT sum(greatest(0, least(e, fe) - greatest(s, fs))) FROM own JOIN free f ON f.rec_id = own.rec_id AND f.me = own.me WHERE own.rec_id = who.rec_id AND own.me = who.me), 0) AS BIGINT) AS clean_ms FROM who),
st AS (SELECT rec_id, me, unnest(range(fs, fe - 2999, 250)) AS st FROM free JOIN clean USING (rec_id, me) WHERE fe - fs >= 3000 AND clean_ms >= 1500),
cov AS (SELECT st.rec_id, st.me, st.st, CAST(sum(greatest(0, least(e, st + 3000) - greatest(s, st))) AS BIGINT) AS covered FROM st JOIN own ON own.rec_id = st.rec_id AND own.me = st.me GROUP BY ALL HAVING sum(greatest(0, least(e, st + 3000) - greatest(s, st))) >= 1500),
near AS (SELECT * FROM (SELECT *, max(covered) OVER (PARTITION BY rec_id, me) AS best FROM cov) WHERE covered >= best - 500),
placed AS (SELECT *, row_number() OVER (PARTITION BY rec_id, me ORDER BY st) - 1 AS i, count(*) OVER (PARTITION BY rec_id, me) AS n FROM near)"""


def _windows(spark, sf_dir):
    w = settle(d.words(spark, sf_dir))
    return op.candidate_windows(settle(d.turns(w).select("rec_id", "speaker", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))), _totals(w))


@query("w19_candidate_windows", _FREE + " SELECT rec_id, me AS speaker, st AS start_ms, covered FROM placed WHERE i IN (SELECT k * n // 48 FROM range(48) r(k))")
def w19(spark, sf_dir):
    return _windows(spark, sf_dir)[0]


@query("w19_clean_speech", _FREE + " SELECT rec_id, me AS speaker, clean_ms, clean_ms >= 1500 AS enough FROM clean")
def w19c(spark, sf_dir):
    return _windows(spark, sf_dir)[1]


#: Sentences as turns of three speakers in turn, so that few voices have three seconds to themselves; embeddings stand for sounds by time.
_SHORT = _FREE.replace(d.TURNS_SQL, d.SEGMENTS_SQL + """,
turns AS (SELECT rec_id, CAST((row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, turn, sn) - 1) % 3 AS INT) AS speaker, start_ms, end_ms FROM segments)""") + """,
emb AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS x, count(*) OVER () AS n FROM embeddings),
alone AS (SELECT own.rec_id, own.me, greatest(s, fs) AS s, least(e, fe) AS e FROM own JOIN free f ON f.rec_id = own.rec_id AND f.me = own.me AND least(e, fe) > greatest(s, fs)),
cutup AS (SELECT rec_id, me, s, e, unnest(range(s, e, 6000)) AS pt FROM alone),
pieces AS (SELECT rec_id, me, pt, least(e, pt + 6000) - pt AS dur FROM cutup WHERE least(e, pt + 6000) - pt >= 1000 OR e - s < 1000),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rec_id, me ORDER BY dur DESC, pt) AS k FROM pieces),
dims AS (SELECT rec_id, me, dur, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM ranked JOIN emb ON emb.i = (rec_id * 7 + pt // 250) % emb.n WHERE k <= 24 AND dur >= 300),
mean AS (SELECT rec_id, me, dim, sum(v * dur) AS v FROM dims GROUP BY ALL),
cent AS (SELECT rec_id, me, list(v ORDER BY dim) AS c FROM mean GROUP BY ALL)"""


def _voices(spark, sf_dir):
    """Turns, totals, and what embeds rows by their place ``at``."""
    w = settle(d.words(spark, sf_dir))
    s = d.segments(w)
    number = F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms", "turn", "sn")) - 1
    turns = settle(s.select("rec_id", (number % 3).cast("int").alias("speaker"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    numbered = settle(e.select((F.row_number().over(Window.orderBy("vec_id")) - 1).alias("i"), "embedding"))
    n = numbered.count()
    return turns, _totals(w), lambda rows, at: rows.withColumn("i", (F.col("rec_id") * 7 + F.floor(F.col(at) / 250)) % n).join(numbered, "i").drop("i")


def _centroids(clean, embed):
    pieces = embed(op.sample_pieces(clean), "s").withColumn("voice", F.struct("rec_id", "speaker"))
    c = sig.speaker_centroid(pieces, "voice").groupBy("voice").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda y: y["x"]).alias("centroid"))
    return c.select("voice.rec_id", "voice.speaker", "centroid")


@query("a15_centroid_pieces", _SHORT + " SELECT rec_id, me AS speaker, row_number() OVER (PARTITION BY rec_id, me ORDER BY pt) - 1 AS piece, pt AS s, dur AS dur_ms FROM pieces")
def _(spark, sf_dir):
    turns, totals, _ = _voices(spark, sf_dir)
    return op.sample_pieces(op.clean_speech(turns, totals))


@query("w19_choose_sample", _SHORT + ", sim AS (SELECT p.rec_id, p.me, st, round(list_cosine_similarity(x, c), 6) AS c FROM placed p JOIN emb ON emb.i = (p.rec_id * 7 + st // 250) % emb.n JOIN cent ON cent.rec_id = p.rec_id AND cent.me = p.me WHERE p.i IN (SELECT k * p.n // 48 FROM range(48) r(k))) SELECT rec_id, me AS speaker, max(c) AS similarity FROM sim GROUP BY ALL")
def _(spark, sf_dir):
    turns, totals, embed = _voices(spark, sf_dir)
    centroids = _centroids(op.clean_speech(turns, totals), embed)
    chosen = op.choose_sample(embed(op.candidate_windows(turns, totals)[0], "start_ms"), centroids)
    return chosen.select("rec_id", "speaker", F.round("similarity", 6).alias("similarity"))


@query(
    "w19_assembled",
    _SHORT
    + """, short AS (SELECT a.rec_id, a.me, s, e - s AS dur, round(list_cosine_similarity(x, c), 9) AS c FROM alone a JOIN clean USING (rec_id, me) JOIN emb ON emb.i = (a.rec_id * 7 + s // 250) % emb.n JOIN cent ON cent.rec_id = a.rec_id AND cent.me = a.me WHERE e - s >= 300 AND clean_ms >= 1500 AND NOT EXISTS (SELECT 1 FROM placed p WHERE p.rec_id = a.rec_id AND p.me = a.me)),
laid AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY rec_id, me ORDER BY c DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(dur) OVER (PARTITION BY rec_id, me) AS t FROM short),
again AS (SELECT *, b + k * t AS pt FROM laid, range(11) r(k) WHERE b + k * t < 3000)
SELECT rec_id, me AS speaker, row_number() OVER (PARTITION BY rec_id, me ORDER BY pt) - 1 AS ord, s, CAST(least(dur, 3000 - pt) AS BIGINT) AS taken_ms FROM again""",
)
def _(spark, sf_dir):
    turns, totals, embed = _voices(spark, sf_dir)
    clean = settle(op.clean_speech(turns, totals))
    windows, told = op.candidate_windows(turns, totals)
    left = told.where("enough").join(windows.select("rec_id", "speaker"), ["rec_id", "speaker"], "left_anti")
    return op.assemble_sample(embed(clean.join(left.select("rec_id", "speaker"), ["rec_id", "speaker"], "left_semi"), "s"), _centroids(clean, embed))


@query("x4_merge_spans", ORACLES["w4_merge_spans"])
def x4(spark, sf_dir):
    intervals.register(spark)
    return spark.sql("SELECT * FROM merge_spans(TABLE({spans}) PARTITION BY rec_id ORDER BY (s, e))", spans=_spans(d.words(spark, sf_dir)))


@query("x4_silences", ORACLES["w5_silences"])
def x4s(spark, sf_dir):
    intervals.register(spark)
    w = settle(d.words(spark, sf_dir))
    rows = _spans(w).join(_totals(w), "rec_id")
    return spark.sql("SELECT * FROM silences(TABLE({spans}) PARTITION BY rec_id ORDER BY (s, e), 300)", spans=rows)


@query("x3_recognise", f"WITH {d.SPOKEN_SQL} SELECT rec_id, id, length(text) AS heard, end_ms - start_ms AS length_ms FROM spoken")
def x3(spark, sf_dir):
    """A stand-in for a model: it hears how long a segment's text is."""
    s = d.spoken(d.words(spark, sf_dir)).select("rec_id", "id", "text", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"))
    load = lambda: lambda rows: rows.assign(heard=rows["text"].str.len())[["rec_id", "id", "heard", "length_ms"]]
    return hooks.recognise(s, load, "rec_id long, id long, heard long, length_ms long")
