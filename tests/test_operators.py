"""Library operators on hand-made rows: nulls, ties, empty tables and cases that the derived tables don't have."""

import json

import pytest
from pyspark.sql import functions as F

from tidewords.functions import scalar
from tidewords.operators import dictionaries, evaluation, exporters, isolation, jobs, reports, signals, spans, speakers, wordstream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def words_of(spark, listed):
    """(segment, word, start, end, speaker) as transcript words."""
    return spark.createDataFrame([(1, s, i, w, a, b, who, 900) for i, (s, w, a, b, who) in enumerate(listed)], "rec_id long, id long, seq long, word string, start_ms long, end_ms long, speaker string, conf_milli long")


def test_cues_break_at_pauses_and_full_lines(spark):
    listed = [(0, "a", 0, 100, "s"), (0, "b", 3000, 3100, "s"), (1, "c", 6001, 6100, None)]
    got = rows(exporters.cues(words_of(spark, listed)).select("start_ms", "end_ms", "text"))
    assert got == [(0, 3100, "[s]: a b"), (6001, 6100, "c")]
    short = [(0, "word", 10 * i, 10 * i + 5, None) for i in range(900)]
    lines = exporters.cues(words_of(spark, short)).orderBy("cue").collect()
    per = 1000 // 4
    assert [r.text.count("word") for r in lines] == [2 * per, 900 - 2 * per] and lines[0].text.split("\n")[0].count("word") == per


def test_a_transcript_in_every_format(spark):
    s = spark.createDataFrame([(1, 0, " Hi\tyou. ", 0, 1500, "ann"), (1, 1, "Bye", 3_600_000, 3_600_500, None)], "rec_id long, id long, text string, start_ms long, end_ms long, speaker string")
    w = words_of(spark, [(0, "Hi", 0, 400, "ann"), (0, "you.", 500, 1500, "ann"), (1, "Bye", 3_600_000, 3_600_500, None)])
    text = lambda lines: exporters.documents(lines).first().body
    assert text(exporters.text_lines(s)) == "[ann]: Hi\tyou.\nBye\n"
    assert text(exporters.tsv(s)) == "start\tend\ttext\n0\t1500\tHi you.\n3600000\t3600500\tBye\n"
    assert text(exporters.srt(s)) == "1\n00:00:00,000 --> 00:00:01,500\nann:  Hi\tyou. \n\n2\n01:00:00,000 --> 01:00:00,500\nBye\n\n"
    assert text(exporters.vtt(s)) == "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\n<v ann> Hi\tyou. </v>\n\n01:00:00.000 --> 01:00:00.500\nBye\n\n"
    found = exporters.all_cues(w, s)
    assert text(exporters.cue_vtt(found)) == "WEBVTT\n\n00:00.000 --> 00:01.500\n[ann]: Hi you.\n\n01:00:00.000 --> 01:00:00.500\nBye\n\n"
    assert text(exporters.cue_srt(found)).startswith("1\n00:00:00,000 --> 00:00:01,500\n[ann]: Hi you.\n\n2\n")
    assert text(exporters.dialogue(s)) == "ann: Hi\tyou.\nBye\n" and exporters.plain_text(s).first().text == "Hi\tyou. Bye"
    first = json.loads(exporters.word_json(s, w).orderBy("id").first().segment)
    assert first == {"start": 0.0, "end": 1.5, "text": "Hi\tyou.", "words": [{"word": "Hi", "start": 0.0, "end": 0.4, "score": 0.9, "speaker": "ann"}, {"word": "you.", "start": 0.5, "end": 1.5, "score": 0.9, "speaker": "ann"}], "speaker": "ann"}


def test_segments_without_words_become_cues(spark):
    s = spark.createDataFrame([(1, 0, "x --> y", 0, 10, None)], "rec_id long, id long, text string, start_ms long, end_ms long, speaker string")
    none = words_of(spark, [(0, "w", 0, 1, None)]).limit(0)
    assert rows(exporters.all_cues(none, s).select("text")) == [("x -> y",)]
    assert exporters.srt(s.limit(0)).count() == exporters.cues(none).count() == 0


def test_phrases_refuse_their_dictionary(spark):
    p = spark.createDataFrame([("a", 0, " x  y "), ("a", 1, "x y"), ("a", 2, " "), ("b", 0, "q" * 201), ("b", 1, "ok"), ("c", 0, "u\nv"), ("d", 0, "1"), ("d", 1, "2"), ("d", 2, "3")], "dict_key string, ord int, phrase string")
    kept, refused = dictionaries.clean_phrases(p, 2)
    assert rows(kept.select("dict_key", "ord", "phrase")) == [("a", 0, "x y")]
    assert rows(refused) == [("b", "long phrase"), ("c", "line break"), ("d", "too many phrases")]
    assert dictionaries.clean_phrases(p.limit(0))[0].count() == 0


def test_dictionary_files(spark):
    files = {"array": '["a", " b"]', "object": '{"phrases": ["c"]}', "broken": "[oops", "lines": "Words\n# note\n d \n\ne", "line": "term, f ,g\n", "empty": " \n", "comment": "# only"}
    f = spark.createDataFrame(list(files.items()), "path string, content string")
    good, bad = dictionaries.read_files(f)
    assert rows(good) == sorted([("array", 0, "a"), ("array", 1, " b"), ("object", 0, "c"), ("lines", 0, "d"), ("lines", 1, "e"), ("line", 0, "f"), ("line", 1, "g")])
    assert rows(bad) == [("broken", "doesn't parse"), ("comment", "no phrases"), ("empty", "no phrases")]


def test_jobs_expire_and_purge(spark):
    j = spark.createDataFrame([("a", "expired", None, 5, None), ("b", "failed", None, 5, 50), ("c", "queued", "k", 1, None)], "id string, status string, api_key_id string, created_ms long, finished_ms long")
    assert rows(jobs.purge(j, F.lit(20), 10).select("id")) == [("a",)] and jobs.purge(j, F.lit(20), 0).count() == 0
    assert rows(jobs.filter_jobs(j, None, statuses=("expired",)).select("id")) == [("a",)]
    with pytest.raises(ValueError):
        jobs.filter_jobs(j, None, statuses=("lost",))


def test_words_without_turns_and_between_turns(spark):
    w = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 50, 50), (1, 2, 70, 80), (2, 0, 0, 5)], "rec_id long, wid long, start_ms long, end_ms long")
    t = spark.createDataFrame([(1, 0, 7, 20, 60), (1, 1, 8, 20, 60), (1, 2, 9, 84, 90)], "rec_id long, turn_ord long, speaker int, start_ms long, end_ms long")
    got = {(r.rec_id, r.wid): (r.speaker, r.speaker_conf) for r in speakers.attribute(w, t).collect()}
    assert got == {(1, 0): (7, 0.3), (1, 1): (7, 0.3), (1, 2): (9, 0.3), (2, 0): (None, None)}
    assert speakers.attribute(w.limit(0), t).count() == 0


@pytest.mark.parametrize(
    ("unit", "tokens", "want"),
    [
        ("char", ["h", "i", "▁", "y", "o"], ["hi", "yo"]),
        ("cjkchar", ["日", "本"], ["日", "本"]),
        ("cjkchar+bpe", ["▁a", "b", "日", "本", "▁c"], ["ab", "日", "本", "c"]),
        ("bpe", ["▁a", "<unk>", "b", " c", "▁"], ["ab", "c"]),
    ],
)
def test_assembling_words_by_unit(spark, unit, tokens, want):
    t = spark.createDataFrame([(1, i, x, 10 * i, 0, -0.1, 1000) for i, x in enumerate(tokens)], "rec_id long, k long, token string, ts_ms long, dur_ms long, logprob double, seg_ms long")
    assert [r.word for r in wordstream.assemble_words(t, ["rec_id"], unit).orderBy("k").collect()] == want


def test_bad_cursors_are_null(spark):
    c = ["", "A", "!!", "eDp5", "MTIz", "MTIzOg", "MTIzOmE"]
    got = spark.createDataFrame([(x,) for x in c], "c string").select(scalar.cursor_decode(F.col("c")).alias("d")).collect()
    assert [r.d and tuple(r.d) for r in got] == [None] * 6 + [(123, "a")]


def test_word_errors(spark):
    p = spark.createDataFrame([("a b c", "a x c d"), ("", ""), ("...", "a"), ("Hello, World!", "hello world")], "reference string, hypothesis string")
    assert [(r.edits, r.wer) for r in evaluation.word_error_rate(p).collect()] == [(2, 2 / 3), (0, 0.0), (1, 1.0), (0, 0.0)]


def test_drift_matches_a_plain_walk():
    base = [("a", 0), ("b", 10), ("c", 20), ("d", 30)]
    assert evaluation._align(base, [("a", 1), ("x", 5), ("b", 12), ("d", 33)]) == [(0, 0), (1, 2), (3, 3)]
    assert evaluation._align(base, []) == []


def test_single_echo_needs_a_margin(spark):
    listed = [(1, "a", 0, "yes", 0, -20.0), (1, "b", 0, "Yes!", 100, -22.0), (1, "a", 5, "no", 9000, -30.0), (1, "b", 5, "no", 9100, -20.0)]
    w = spark.createDataFrame(listed, "rec_id long, track string, seq long, word string, start_ms long, db double")
    assert rows(isolation.echoes(w)) == [(1, "a", 5)]


def test_percentile_of_ties_and_nulls(spark):
    v = spark.createDataFrame([(1, x) for x in (5.0, 5.0, 1.0, None, 9.0)] + [(2, 3.0)], "rec_id long, v double")
    assert rows(signals.percentile_floor(v, ["rec_id"], "v", 0.5)) == [(1, 5.0), (2, 3.0)]
    assert rows(signals.percentile_floor(v, ["rec_id"], "v", 0.95)) == [(1, 5.0), (2, 3.0)]


def test_batches_and_spans(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate([70_000, 20_000, 30_000, 20_000])], "rec_id long, id long, length_ms long")
    assert [r.batch for r in reports.pack_batches(s).orderBy("id").collect()] == [0, 1, 1, 2]
    c = spark.createDataFrame([("ok", 3, 2, [1, 2]), ("few", 3, 2, [1]), ("none", 1, 2, None)], "stage string, inputs int, outputs int, spans array<int>")
    assert rows(reports.check_spans(c).select("stage")) == [("few",), ("none",)]
    x = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 5, 5)], "rec_id long, s long, e long")
    assert rows(spans.merge_spans(x)) == [(1, 0, 20)]
