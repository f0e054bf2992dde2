"""Queries over text stages: spoken numbers written, punctuation put back, chains of both, and who can have them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewords.operators import normalise as n
from tidewords.operators import stages as st
from tidewords.operators import wordstream as ws
from tidewords.operators.patterns import meet
from tidewords.plans.registry import query
from tidewords.sources import derived as d

#: Words that conversations' words become: any of them, or runs that a phone number, a time, a date or an amount may be.
MIXED = "сто двадцать пять рублей тысяч две двенадцать процентов сорок три один ноль миллиона долларов евро тридцать семьсот девять".split()
DIGITS = "ноль один два три четыре пять шесть семь восемь девять".split()
HOURS, MINUTES = "девять час десять двадцать двух".split(), "тридцать пять пятнадцать сорок".split()
DAYS, MONTHS = "пятого первого двадцатого третье шестнадцатого".split(), "декабря мая марта".split()


def spoken_numbers(words):
    """Words that speak numbers in place of the conversations' words; marks at their ends and times stay."""
    pick = lambda listed, k: F.element_at(F.array(*(F.lit(x) for x in listed)), (k % len(listed) + 1).cast("int"))
    wid, length = F.col("wid"), F.length("word")
    block, k = F.floor(wid / 12) % 5, F.floor(wid / 12)
    said = (
        F.when((block == 0) & (wid % 12 == 0), "плюс")
        .when(block == 0, pick(DIGITS, wid * wid + length))
        .when((block == 1) & (wid % 4 == 0), pick(HOURS, k)).when((block == 1) & (wid % 4 == 1), "часов").when((block == 1) & (wid % 4 == 2), pick(MINUTES, k + length)).when(block == 1, "минут")
        .when((block == 2) & (wid % 3 == 0), pick(["двадцать", "Тридцать", "сто"], k)).when((block == 2) & (wid % 3 == 1), pick(DAYS, k + length)).when(block == 2, pick(MONTHS, wid))
        .when((length + wid) % 7 < 6, pick(MIXED, length * 7 + wid * wid))
        .otherwise(F.col("word"))
    )
    return words.withColumn("word", F.concat(said, F.regexp_extract("word", r"[.,!?;:]*$", 0)))


def _list(listed) -> str:
    return "[" + ", ".join(f"'{x}'" for x in listed) + "]"


def _pick(listed, k: str) -> str:
    return f"{_list(listed)}[CAST(({k}) % {len(listed)} + 1 AS BIGINT)]"


NUMBERS_SQL = f"""{d.WORDS_SQL},
numbers AS (SELECT rec_id, channel, wid AS seq, CASE
  WHEN b = 0 AND wid % 12 = 0 THEN 'плюс' WHEN b = 0 THEN {_pick(DIGITS, "wid * wid + length(word)")}
  WHEN b = 1 AND wid % 4 = 0 THEN {_pick(HOURS, "k")} WHEN b = 1 AND wid % 4 = 1 THEN 'часов' WHEN b = 1 AND wid % 4 = 2 THEN {_pick(MINUTES, "k + length(word)")} WHEN b = 1 THEN 'минут'
  WHEN b = 2 AND wid % 3 = 0 THEN {_pick(["двадцать", "Тридцать", "сто"], "k")} WHEN b = 2 AND wid % 3 = 1 THEN {_pick(DAYS, "k + length(word)")} WHEN b = 2 THEN {_pick(MONTHS, "wid")}
  WHEN (length(word) + wid) % 7 < 6 THEN {_pick(MIXED, "length(word) * 7 + wid * wid")} ELSE word END || regexp_extract(word, '[.,!?;:]*$') AS word, start_ms, end_ms, conf_milli
  FROM (SELECT *, wid // 12 % 5 AS b, wid // 12 AS k FROM words))"""
#: Rules over a table of forms. A number is a fold from each place of an island on; a walk then takes the places that matches leave.
_LEXICON = ", ".join(f"('{f}', '{k}', {v}, '{s}')" for f, k, v, s in n.RU.lexicon)


def rules_sql(source: str) -> str:
    """Common tables up to ``written`` (rec_id, channel, seq, word, start_ms, end_ms, conf_milli, original, span) of a table of words."""
    number = "list_reduce(list_prepend({'k': '', 'v': 0::BIGINT, 'm': false, 'total': 0::BIGINT, 'grp': 0::BIGINT, 'opened': false, 'n': 0, 'over': false, 'bad': false}, list_transform(ws[i + 1:], lambda x: {'k': x.kind, 'v': x.value, 'm': x.mark <> '', 'total': 0::BIGINT, 'grp': 0::BIGINT, 'opened': false, 'n': 0, 'over': false, 'bad': false})), lambda s, x: CASE WHEN s.over OR s.bad THEN s WHEN x.k NOT IN ('unit', 'ten', 'hundred', 'scale') THEN {'k': '', 'v': 0::BIGINT, 'm': false, 'total': s.total, 'grp': s.grp, 'opened': s.opened, 'n': s.n, 'over': true, 'bad': false} WHEN x.k = 'unit' AND s.opened AND s.grp % 10 <> 0 THEN {'k': '', 'v': 0::BIGINT, 'm': false, 'total': 0::BIGINT, 'grp': 0::BIGINT, 'opened': false, 'n': 0, 'over': true, 'bad': true} WHEN x.k = 'scale' THEN {'k': '', 'v': 0::BIGINT, 'm': false, 'total': s.total + CASE WHEN s.grp = 0 THEN 1 ELSE s.grp END * x.v, 'grp': 0::BIGINT, 'opened': false, 'n': s.n + 1, 'over': x.m, 'bad': false} ELSE {'k': '', 'v': 0::BIGINT, 'm': false, 'total': s.total, 'grp': s.grp + x.v, 'opened': true, 'n': s.n + 1, 'over': x.m, 'bad': false} END)"
    return f"""lex AS (SELECT * FROM (VALUES {_LEXICON}) v(form, kind, value, sign)),
marked AS (SELECT s.*, regexp_replace(word, '[.,!?;:]+$', '') AS stem, kind, value::BIGINT AS value, sign FROM {source} s LEFT JOIN lex ON form = lower(regexp_replace(word, '[.,!?;:]+$', ''))),
opened AS (SELECT *, kind IS NULL OR lag(kind) OVER o IS NULL OR start_ms - lag(end_ms) OVER o > 350 AS opens FROM marked WINDOW o AS (PARTITION BY rec_id, channel ORDER BY seq)),
dealt AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, channel ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM opened),
isl AS (SELECT rec_id, channel, island, list({{'seq': seq, 'kind': kind, 'value': value, 'sign': sign, 'stem': stem, 'mark': substr(word, length(stem) + 1), 'word': word, 'start_ms': start_ms, 'end_ms': end_ms, 'conf': conf_milli}} ORDER BY seq) AS ws FROM dealt WHERE kind IS NOT NULL GROUP BY ALL),
places AS (SELECT *, unnest(range(len(ws))) AS i, len(ws) AS size FROM isl),
folded AS (SELECT *, {number} AS f FROM places),
num AS (SELECT * EXCLUDE (f), CASE WHEN f.n > 0 THEN f.total + f.grp END AS v, CASE WHEN f.n > 0 THEN f.n END AS c, ws[i + 1] AS w0, CASE WHEN f.n > 0 THEN ws[i + f.n + 1] END AS nx,
  coalesce(list_position(list_transform(ws[i + 1 + (ws[i + 1].kind = 'plus')::INT:], lambda x: NOT (x.kind = 'unit' AND x.value <= 9)), true), size - i - (ws[i + 1].kind = 'plus')::INT + 1) - 1 AS digits FROM folded),
two AS (SELECT a.*, b.v AS v2, b.c AS c2, b.nx AS nx2, a.ws[a.i + 2] AS w1, a.ws[a.i + 3] AS w2 FROM num a LEFT JOIN num b ON b.rec_id = a.rec_id AND b.channel = a.channel AND b.island = a.island AND a.nx.kind = 'hour' AND b.i = a.i + a.c + 1),
met AS (SELECT rec_id, channel, island, i, ws, size, CASE
  WHEN digits >= 10 THEN {{'n': digits + (w0.kind = 'plus')::INT, 't': CASE WHEN w0.kind = 'plus' THEN '+' ELSE '' END || array_to_string(list_transform(ws[i + 1 + (w0.kind = 'plus')::INT:i + digits + (w0.kind = 'plus')::INT], lambda x: x.value), '') || ws[i + digits + (w0.kind = 'plus')::INT].mark}}
  WHEN v <= 23 AND nx.kind = 'hour' AND v2 <= 59 AND nx2.kind = 'minute' THEN {{'n': c + c2 + 2, 't': v || ':' || lpad(v2::VARCHAR, 2, '0') || nx2.mark}}
  WHEN w0.sign = 'day' AND w1.kind = 'ordinal' AND w1.value <= 9 AND w2.kind = 'month' THEN {{'n': 3, 't': (w0.value + w1.value) || ' ' || w2.stem || w2.mark}}
  WHEN w0.kind = 'ordinal' AND w1.kind = 'month' THEN {{'n': 2, 't': w0.value || ' ' || w1.stem || w1.mark}}
  WHEN nx.kind = 'currency' THEN {{'n': c + 1, 't': CASE WHEN right(nx.sign, 1) = '.' THEN v || ' ' || nx.sign ELSE nx.sign || v END || nx.mark}}
  WHEN nx.kind = 'percent' THEN {{'n': c + 1, 't': v || '%' || nx.mark}}
  WHEN c > 1 OR v >= 10 THEN {{'n': c, 't': v || ws[i + c].mark}} END AS m FROM two),
walk AS (SELECT rec_id, channel, island, i, coalesce(m.n, 1) AS n, m.t AS t, ws, size FROM met WHERE i = 0
  UNION ALL SELECT b.rec_id, b.channel, b.island, b.i, coalesce(b.m.n, 1), b.m.t, b.ws, b.size FROM walk a JOIN met b ON b.rec_id = a.rec_id AND b.channel = a.channel AND b.island = a.island AND b.i = a.i + a.n),
out AS (SELECT rec_id, channel, t, n, ws[i + 1] AS a, ws[i + n] AS z, array_to_string(list_transform(ws[i + 1:i + n], lambda x: x.word), ' ') AS said, list_min(list_transform(ws[i + 1:i + n], lambda x: x.conf)) AS conf FROM walk),
written AS (SELECT rec_id, channel, a.seq AS seq, coalesce(t, a.word) AS word, a.start_ms AS start_ms, z.end_ms AS end_ms, conf AS conf_milli, CASE WHEN t <> said THEN said END AS original, n AS span FROM out
  UNION ALL SELECT rec_id, channel, seq, word, start_ms, end_ms, conf_milli, NULL, 1 FROM dealt WHERE kind IS NULL)"""


_COLUMNS = ["rec_id", "channel", "seq", "word", "start_ms", "end_ms", "conf_milli", "original", "span"]


def _stream(spark, sf_dir):
    return spoken_numbers(d.words(spark, sf_dir)).select("rec_id", "channel", F.col("wid").alias("seq"), "word", "start_ms", "end_ms", "conf_milli")


@query("w11_itn_rewrite", f"WITH RECURSIVE {NUMBERS_SQL}, {rules_sql('numbers')} SELECT {', '.join(_COLUMNS)} FROM written")
def _(spark, sf_dir):
    return n.rewrite(_stream(spark, sf_dir), st.rules_for("ru-RU")).select(*_COLUMNS)


#: Punctuation-only words join the word before them, then numbers are written; spans count the first words.
_BROKEN = f"""{NUMBERS_SQL},
parted AS (SELECT rec_id, channel, 2 * seq AS seq, CASE WHEN p = '' THEN word ELSE left(word, length(word) - length(p)) END AS word, start_ms, end_ms, conf_milli FROM (SELECT *, regexp_extract(word, '[.,!?;:]*$') AS p FROM numbers)
  UNION ALL SELECT rec_id, channel, 2 * seq + 1, regexp_extract(word, '[.,!?;:]*$'), end_ms, end_ms, conf_milli FROM numbers WHERE regexp_matches(word, '[.,!?;:]$')),
joined AS (SELECT rec_id, channel, min(seq) AS seq, string_agg(word, '' ORDER BY seq) AS word, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(conf_milli, seq) AS conf_milli, count(*) AS took
  FROM (SELECT *, count(*) FILTER (NOT regexp_matches(word, '^[\\p{{P}}\\p{{S}}]+$')) OVER (PARTITION BY rec_id, channel ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM parted) GROUP BY rec_id, channel, g)"""


def join_marks(words):
    """A stage: words of punctuation alone join the word before them."""
    keys = st.STREAM
    merged = ws.merge_punctuation(words, keys, "seq").select(*keys, "seq", "word", "start_ms", "end_ms")
    took = F.lead("__n").over(Window.partitionBy(*keys).orderBy("seq")) - F.col("__n")
    numbered = words.withColumns({"__n": F.row_number().over(Window.partitionBy(*keys).orderBy("seq")), "__all": F.count("*").over(Window.partitionBy(*keys))})
    rest = [c for c in words.columns if c not in ("word", "start_ms", "end_ms")]
    out = meet(merged, numbered.select(*rest, "__n", "__all"), [*keys, "seq"])
    return out.withColumn("span", F.coalesce(took, F.col("__all") - F.col("__n") + 1)).drop("__n", "__all")


@query("w12_apply_chain", f"WITH RECURSIVE {_BROKEN}, {rules_sql('joined')}, summed AS (SELECT w.rec_id, w.channel, w.seq, w.word, w.original, w.start_ms, w.end_ms, (SELECT sum(took) FROM joined j WHERE j.rec_id = w.rec_id AND j.channel = w.channel AND j.seq >= w.seq AND j.seq < coalesce(w.nxt, 9e15)) AS span FROM (SELECT *, lead(seq) OVER (PARTITION BY rec_id, channel ORDER BY seq) AS nxt FROM written) w) SELECT rec_id, channel, seq, word, original, CAST(span AS BIGINT) AS span, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, channel, seq) - 1 AS id FROM summed")
def _(spark, sf_dir):
    w = _stream(spark, sf_dir)
    mark = F.regexp_extract("word", r"[.,!?;:]*$", 0)
    head = w.withColumns({"word": F.expr("left(word, length(word) - length(regexp_extract(word, '[.,!?;:]*$', 0)))"), "seq": 2 * F.col("seq")})
    tail = w.where(mark != "").withColumns({"word": mark, "seq": 2 * F.col("seq") + 1, "start_ms": F.col("end_ms")})
    chain = [st.Stage("marks", join_marks), st.number_stage("ru")]
    return st.apply_chain(head.unionByName(tail), chain).select("rec_id", "channel", "seq", "word", "original", "span", "id")


#: Words come in lower case without marks; a punctuated text puts both back, but where its letters differ; then numbers are written.
@query("x2_stage_chain", f"WITH RECURSIVE {NUMBERS_SQL}, bare AS (SELECT rec_id, channel, seq, CASE WHEN rec_id % 3 = 0 AND number // 200 = 0 THEN lower(regexp_replace(word, '[.,!?;:]+$', '')) ELSE word END AS word, start_ms, end_ms, conf_milli FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, channel ORDER BY seq) - 1 AS number FROM numbers)), {rules_sql('bare')} SELECT {', '.join(_COLUMNS)} FROM written")
def _(spark, sf_dir):
    heard = _stream(spark, sf_dir)

    def model(chunks):
        """Stands for a punctuation model: it knows the text, but speaks of something else in some chunks."""
        keys = [*st.STREAM, "seq"]
        wrote = meet(chunks.select(*keys, "chunk"), heard.select(*keys, F.col("word").alias("wrote")), keys).groupBy(*st.STREAM, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "wrote"))), lambda x: x["wrote"]), " ").alias("punctuated"))
        return wrote.withColumn("punctuated", F.when((F.col("rec_id") % 3 == 0) & (F.col("chunk") == 0), F.concat(F.lit("zzz "), "punctuated")).otherwise(F.col("punctuated")))

    bare = heard.withColumn("word", F.lower(F.regexp_replace("word", "[.,!?;:]+$", "")))
    out, _ = st.run_chain(bare, [ws.punctuation_stage(model), st.number_stage("ru")])
    return out.select(*_COLUMNS)


_ASKED = "SELECT DISTINCT conv_id AS rec_id, CASE conv_id % 5 WHEN 0 THEN 'ru-RU' WHEN 1 THEN '' WHEN 2 THEN ' RU' WHEN 3 THEN 'fr' END AS language, conv_id % 2 = 0 AS punctuate, conv_id % 7 <> 0 AS itn, conv_id % 4 = 0 AS builtin FROM conversations"


def _asked(spark, sf_dir):
    c = F.col("conv_id")
    language = F.when(c % 5 == 0, "ru-RU").when(c % 5 == 1, "").when(c % 5 == 2, " RU").when(c % 5 == 3, "fr")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(c.alias("rec_id"), language.alias("language"), (c % 2 == 0).alias("punctuate"), (c % 7 != 0).alias("itn"), (c % 4 == 0).alias("builtin")).distinct()


@query("x1_routed_stages", f"WITH r AS ({_ASKED}) SELECT rec_id, 'punctuation' AS stage, NULL AS locale FROM r WHERE punctuate AND NOT builtin UNION ALL SELECT rec_id, 'itn', 'ru' FROM r WHERE itn AND coalesce(nullif(trim(lower(language)), ''), 'ru') LIKE 'ru%'")
def _(spark, sf_dir):
    return st.route(_asked(spark, sf_dir), can_punctuate=True)[0]


@query("x1_refused_stages", f"WITH r AS ({_ASKED}) SELECT rec_id, 'punctuation_unavailable' AS code, 'the model doesn''t punctuate and no other does' AS message FROM r WHERE punctuate AND NOT builtin UNION ALL SELECT rec_id, 'itn_unavailable', 'no rules for locale fr; there are ru' FROM r WHERE itn AND language = 'fr'")
def _(spark, sf_dir):
    return st.route(_asked(spark, sf_dir), can_punctuate=False)[1]
