"""Whole transcripts written and read back, interval functions in SQL, derived segments."""

import json

import pytest
from pyspark.sql import functions as F

from tidewords.functions import intervals
from tidewords.operators import exporters, speakers
from tidewords.sources import derived


def parts(spark):
    rec = spark.createDataFrame(
        [(1, "m", "en", "token", 2000, 500, {"decode": 3}, [("late", 'a "b"')]), (2, None, None, "segment", 0, 5, None, []), (3, "m", "de", "token", 1000, 10, {}, None)],
        f"rec_id long, model string, language string, timestamp_source string, duration_ms long, processing_ms long, stages_ms map<string,bigint>, warnings {exporters.WARNINGS}",
    )
    s = spark.createDataFrame([(1, 0, 0, "ann", 0, 900, " Hi you ", 0.5), (1, 1, 1, None, 1000, 1500, " ", 0.0), (3, 0, 0, "bob", 0, 1000, "ja", 0.25)], "rec_id long, id long, channel int, speaker string, start_ms long, end_ms long, text string, avg_conf double")
    w = spark.createDataFrame([(1, 0, 1, "you", 500, 900, 0, "ann", 0), (1, 0, 0, "Hi", 0, 400, 700, "ann", 0)], "rec_id long, id long, seq long, word string, start_ms long, end_ms long, conf_milli long, speaker string, channel int")
    gaps = spark.createDataFrame([(1, 900, 1000), (1, 1500, 2000)], "rec_id long, start_ms long, end_ms long")
    return rec, s, w, gaps


def test_a_whole_transcript(spark):
    docs = {r.rec_id: json.loads(r.result) for r in exporters.result_json(*parts(spark)).collect()}
    one = docs[1]
    assert list(one) == ["id", "model", "language", "duration", "text", "timestamp_source", "segments", "silence", "speakers", "stats", "warnings"]
    assert one["text"] == "Hi you" and one["speakers"] == [{"id": "ann", "total_speech": 0.9, "segments": 1}] and one["warnings"] == [{"code": "late", "message": 'a "b"'}]
    assert one["stats"] == {"audio_duration": 2.0, "processing_ms": 500, "rtf": 0.25, "stages_ms": {"decode": 3}, "segments_total": 2, "speech_ratio": 0.7}
    assert [x["word"] for x in one["segments"][0]["words"]] == ["Hi", "you"] and "speaker" not in one["segments"][1]
    empty = docs[2]
    assert empty["segments"] == empty["silence"] == [] and empty["text"] == "" and not {"model", "language", "speakers", "warnings"} & set(empty)
    assert empty["stats"]["rtf"] == empty["stats"]["speech_ratio"] == 0.0 and docs[3]["stats"]["speech_ratio"] == 1.0


def test_transcripts_come_back(spark):
    rec, s, w, gaps = parts(spark)
    stored = exporters.result_json(rec, s, w, gaps).unionByName(spark.createDataFrame([(9, "{broken"), (8, None)], "rec_id long, result string"))
    words, segments, silence = exporters.read_transcripts(stored)
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert rows(words, "rec_id", "seq", "word", "conf_milli") == [(1, 0, "Hi", 700), (1, 1, "you", 0)]
    assert rows(segments, "rec_id", "id", "start_ms", "end_ms", "avg_conf") == [(1, 0, 0, 900, 0.5), (1, 1, 1000, 1500, 0.0), (3, 0, 0, 1000, 0.25)]
    assert rows(silence, *silence.columns) == [(1, 900, 1000), (1, 1500, 2000)]
    whole, voices, told = exporters.read_summaries(stored)
    assert {r.rec_id: (r.duration_ms, r.n_segments, r.stages_ms) for r in whole.collect()} == {1: (2000, 2, {"decode": 3}), 2: (0, 0, None), 3: (1000, 1, {}), 8: (None, None, None), 9: (None, None, None)}
    assert rows(voices, *voices.columns) == [(1, "ann", 900, 1), (3, "bob", 1000, 1)] and rows(told, *told.columns) == [(1, 0, "late", 'a "b"')]


def test_words_are_listed_twice_and_empty_recordings_have_none(spark):
    rec, s, w, _ = parts(spark)
    docs = {r.rec_id: json.loads(r.document) for r in exporters.word_document(s, w, rec.select("rec_id", "language")).collect()}
    assert [x["word"] for x in docs[1]["word_segments"]] == ["Hi", "you"] and docs[1]["word_segments"] == docs[1]["segments"][0]["words"] and docs[1]["segments"][1]["words"] == []
    assert docs[2] == {"segments": [], "word_segments": []} and docs[3]["language"] == "de"


def test_interval_functions_over_batches(spark):
    intervals.register(spark)
    spans = spark.range(30_000).select((F.col("id") % 3).alias("rec_id"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + F.when(F.col("id") % 300 < 3, 5).otherwise(40)).alias("e"))
    spans = spans.unionByName(spark.createDataFrame([(5, 7, 7), (6, 100, 400), (6, 400, 500), (6, 120, 130)], spans.schema)).withColumn("total", F.lit(300_500).cast("long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    merged = spark.sql("SELECT * FROM merge_spans(TABLE({t}) PARTITION BY rec_id ORDER BY (s, e))", t=spans).collect()
    quiet = spark.sql("SELECT * FROM silences(TABLE({t}) PARTITION BY rec_id ORDER BY (s, e), 20)", t=spans).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, gaps = [], []
    for rec in (0, 1, 2, 5, 6):
        rows = sorted((r.s, r.e) for r in spans.where(F.col("rec_id") == rec).collect())
        at, open_ = 0, None
        for s, e in rows:
            if s - at >= 20:
                gaps.append((rec, at, s))
            at = max(at, e)
            if e > s:
                if open_ and s <= open_[1]:
                    open_ = (open_[0], max(open_[1], e))
                else:
                    want += [(rec, *open_)] if open_ else []
                    open_ = (s, e)
        want += [(rec, *open_)] if open_ else []
        if 300_500 - at >= 20:
            gaps.append((rec, at, 300_500))
    assert sorted(map(tuple, merged)) == sorted(want) and sorted(map(tuple, quiet)) == sorted(gaps)
    none = spans.limit(0)
    assert spark.sql("SELECT * FROM merge_spans(TABLE({t}) PARTITION BY rec_id ORDER BY (s, e))", t=none).count() == 0


RUNS = {
    "aab": "000", "aabb": "0011", "abbb": "0000", "ab": "00", "aabbaa": "001122", "aaxbb": "00011", "aaxaa": "00000", "a": "0", "xaabb": "00011", "??aa": "0011", "aa?bb": "00011",
}


@pytest.mark.parametrize("said", RUNS)
def test_runs_of_speakers(spark, said):
    """Each letter a word of 300 ms by that speaker, ? by nobody."""
    w = spark.createDataFrame([(1, k, 300 * k, 300 * k + 300, None if c == "?" else c) for k, c in enumerate(said)], "rec_id long, seq long, start_ms long, end_ms long, speaker string")
    got = [str(r.group) for r in speakers.speaker_runs(w, ["rec_id"], "seq").orderBy("seq").collect()]
    assert "".join(got) == RUNS[said]


def test_derived_words_know_their_segment(spark):
    w = derived.words(spark, "/root/testdata/sf0.001")
    s, said = derived.spoken(w), derived.spoken_words(w)
    n = said.groupBy("rec_id", "id", "speaker").agg(F.count("*").alias("n"), F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    assert n.count() == s.count() == n.join(s, ["rec_id", "id"]).where("n = n_words AND a = start_ms AND b = end_ms").count()
