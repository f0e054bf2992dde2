"""Spoken numbers, punctuation put back and stage chains on hand-made words."""

import pytest
from pyspark.sql import functions as F

from tidewords import plans
from tidewords.sources import derived
from tidewords.operators import normalise, stages, wordstream

GRID = 400  # ms between the starts of words that last 350


def stream(spark, lines, pauses=()):
    """Each line a channel of recording 1; a longer pause before the words (line, place)."""
    listed = []
    for c, line in enumerate(lines):
        at = 0
        for i, w in enumerate(line.split()):
            at += 1000 if (c, i) in pauses else 0
            listed.append((1, c, i, w, at, at + 350, 900 - i, None))
            at += GRID
    return spark.createDataFrame(listed, "rec_id long, channel int, seq long, word string, start_ms long, end_ms long, conf_milli int, speaker string")


def lines_of(df):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda x: x["word"]), " ")
    return [r[1] for r in sorted(df.groupBy("channel").agg(text).collect())]


CASES = {
    "сто двадцать три": "123", "тысяча": "1000", "три миллиона две тысячи": "3002000", "десять пять": "15", "ноль тысяч": "1000",
    "пять": "пять", "двенадцать": "12", "двадцать пять шесть": "двадцать пять шесть", "тридцать, пять": "30, пять", "Сорок два.": "42.",
    "двадцать пять рублей": "25 руб.", "три доллара!": "$3!", "сто евро": "€100", "рублей сто": "рублей 100", "двадцать, рублей": "20 руб.",
    "пять процентов, да": "5%, да", "сто процентах": "100%",
    "девять часов пять минут": "9:05", "двадцать четыре часа пять минут": "24 часа пять минут", "девять часов": "девять часов", "двадцать часов шестьдесят минут": "20 часов 60 минут",
    "двадцать пятого Декабря.": "25 Декабря.", "первого мая": "1 мая", "тридцатое июня": "30 июня", "двадцатое": "двадцатое", "двадцати пятого мая": "20 5 мая",
    "плюс семь девять один пять два три четыре пять шесть": "плюс семь девять один пять два три четыре пять шесть", "семь девять один пять два три четыре пять шесть ноль!": "7915234560!",
    "плюс семь девять один пять два три четыре пять шесть ноль": "+7915234560", "": "", "слова без чисел": "слова без чисел",
}


def test_every_kind_of_rule(spark):
    said = [k for k in CASES if k]
    assert lines_of(normalise.rewrite(stream(spark, said))) == [CASES[k] for k in said]
    assert normalise.rewrite(stream(spark, said).limit(0)).count() == 0


def test_rewritten_words_keep_times_and_what_was_said(spark):
    w = stream(spark, ["a двадцать пять рублей b", "двадцать пять"], pauses={(1, 1)}).withColumn("speaker", F.when(F.col("seq") == 1, "s"))
    got = {(r.channel, r.seq): r for r in normalise.rewrite(w).collect()}
    r = got[0, 1]
    assert (r.word, r.original, r.start_ms, r.end_ms, r.conf_milli, r.speaker, r.span) == ("25 руб.", "двадцать пять рублей", 400, 1550, 897, "s", 3)
    assert sorted(got) == [(0, 0), (0, 1), (0, 4), (1, 0), (1, 1)] and got[1, 0].word == "20" and got[1, 1].word == "пять" and got[0, 0].original is None
    edge = stream(spark, ["двадцать пять"]).withColumn("start_ms", F.col("start_ms") + F.when(F.col("seq") == 1, 300).otherwise(0))
    assert lines_of(normalise.rewrite(edge)) == ["25"] and lines_of(normalise.rewrite(edge, max_gap_ms=349)) == ["20 пять"]
    null = stream(spark, ["сто два"]).withColumn("word", F.when(F.col("seq") == 0, F.col("word")))
    assert sorted((r.word, r.span) for r in normalise.rewrite(null).collect() if r.word) == [("100", 1)]


def test_a_number_is_said_once_however_a_stream_is_dealt(spark):
    long = " ".join(["плюс", *["семь девять"] * 3000])
    assert lines_of(normalise.rewrite(stream(spark, [long]))) == ["+" + "79" * 3000]


def test_rules_by_locale():
    assert stages.rules_for(" RU-ru ").locale == "ru" and stages.rules_for("ru") is normalise.RU
    with pytest.raises(LookupError, match="no rules for locale de; there are ru"):
        stages.rules_for("de")
    assert len({f for f, *_ in normalise.RU.lexicon}) == len(normalise.RU.lexicon)


def test_stages_that_do_not_add_up_are_refused_by_stream(spark):
    w = stream(spark, ["a b c d", "e f"])
    spanned = lambda n: F.lit(n).cast("long")
    pairs = stages.Stage("pairs", lambda x: x.where("seq % 2 = 0").withColumn("span", spanned(2)))
    lossy = stages.Stage("lossy", lambda x: x.where("channel = 1 OR seq > 0").withColumn("span", spanned(None)))
    out, refused = stages.run_chain(w, [lossy, pairs, pairs.__class__("again", lambda x: x.where("seq % 4 = 0").withColumn("span", F.when(F.col("channel") == 0, 2).otherwise(1)))])
    assert [tuple(r) for r in refused.collect()] == [(1, 0, "lossy", "3 words for 4 inputs without spans")]
    assert sorted((r.channel, r.seq, r.word, r.span) for r in out.collect()) == [(0, 0, "a", 4), (1, 0, "e", 2)]
    for made, reason in ((spanned(0), "a word covers 0 inputs"), (spanned(3), "spans cover 6 of 2 inputs"), (F.when(F.col("seq") == 0, 1), "2 words and 1 spans")):
        _, refused = stages.run_chain(w.where("channel = 1"), [stages.Stage("s", lambda x, m=made: x.withColumn("span", m))])
        assert [r.reason for r in refused.collect()] == [reason]
    assert stages.run_chain(w, [])[1].count() == 0 and {r.span for r in stages.run_chain(w, [])[0].collect()} == {1}


def reattached(spark, words, text):
    w = spark.createDataFrame([(1, i, x) for i, x in enumerate(words)], "rec_id long, seq long, word string")
    p = spark.createDataFrame([(1, text)], "rec_id long, punctuated string")
    return [r.word for r in wordstream.reattach_text(w, p, ["rec_id"]).orderBy("seq").collect()]


@pytest.mark.parametrize(
    "words, text, want",
    [
        (["hello", "world"], "Hello, - world! And more", ["Hello,", "-world!"]),
        (["its", "a", "x"], "It's (a) X", ["It's", "(a)", "X"]),
        (["ab", "c"], "A b .C", ["Ab", ".C"]),
        (["été", "𝄞a"], "«Été» 𝄞A…", ["«Été»", "𝄞A…"]),
        (["a,", "b"], "A b.", ["A", "b."]),
        (["a", "b"], "a c", ["a", "b"]),
        (["a", "b"], "A", ["a", "b"]),
        (["a", "-"], "A -", ["a", "-"]),
        (["a"], None, ["a"]),
        (["a", None], "A B", ["a", None]),
        (["a", "b"], "x A b", ["a", "b"]),
    ],
)
def test_marks_and_case_are_put_back(spark, words, text, want):
    assert reattached(spark, words, text) == want


def test_text_is_put_back_on_the_jvm_alone(spark):
    w = spark.createDataFrame([(1, 0, "a")], "rec_id long, seq long, word string")
    p = spark.createDataFrame([(1, "A")], "rec_id long, punctuated string")
    plan = wordstream.reattach_text(w, p, ["rec_id"])._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_stages_that_requests_get(spark):
    rows = [(1, "ru-RU", True, True, False), (2, None, True, True, True), (3, " FR", False, True, False), (4, "de", False, False, False)]
    r = spark.createDataFrame(rows, "rec_id long, language string, punctuate boolean, itn boolean, builtin boolean")
    routes, told = stages.route(r, can_punctuate=True)
    assert sorted((x.rec_id, x.stage, x.locale) for x in routes.collect()) == [(1, "itn", "ru"), (1, "punctuation", None), (2, "itn", "ru")]
    assert [tuple(x) for x in told.collect()] == [(3, "itn_unavailable", "no rules for locale fr; there are ru")]
    assert [x.code for x in stages.route(r.where("rec_id = 1"), can_punctuate=False)[1].collect()] == ["punctuation_unavailable"]


#: On this table words are dealt into several tasks.
DEALT = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["w1_assemble_words", "w4_merge_spans", "w5_silences", "w5b_transcript_silences", "w11_itn_rewrite", "w18_cue_groups", "w23_reattach_text", "s13_write_word_json", "s13_word_document", "s14_verbose_words", "f25_cue_join", "j7_prune_words", "j11_word_at", "j12_neighbour_words", "j13_current_words", "a18_start_drift"])
def test_words_are_dealt_once_by_recording(spark, name):
    """The text's exchange is the only one, so that no task grows with the table."""
    plan = plans.QUERIES[name](spark, DEALT)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_words_take_more_tasks_with_more_text(spark):
    said = spark.read.parquet(f"{DEALT}/conversations.parquet")
    n = derived.dealt(said, "conv_id").rdd.getNumPartitions()
    assert n > 1 and derived.dealt(said.unionByName(said), "conv_id").rdd.getNumPartitions() >= 2 * n - 1


def test_a_chain_keeps_no_letters(spark):
    """Marks are put back without a row a letter."""
    w = spark.createDataFrame([(1, 0, "a")], "rec_id long, seq long, word string")
    plan = wordstream.reattach_text(w, spark.createDataFrame([(1, "A")], "rec_id long, punctuated string"), ["rec_id"])
    assert "explode" not in plan._jdf.queryExecution().executedPlan().toString() and "Join" not in plan._jdf.queryExecution().executedPlan().toString()
