"""Distances of transcripts and diarizations from references, sample choice and dictionary files, against plain readings."""

import duckdb
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewords import plans
from tidewords.functions import alignment
from tidewords.operators import dictionaries, evaluation, reports, spans


def table(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
        rows.append(row)
    return rows


def test_columns_of_the_edit_table():
    rng = random.Random(3)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 9])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(90))] for _ in range(2))
        if a:
            assert alignment.last_column(a, b).tolist() == [r[-1] for r in table(a, b)]


@pytest.mark.parametrize("small", [4, 4096])
def test_kinds_of_edits_add_up(monkeypatch, small):
    monkeypatch.setattr(alignment, "SMALL", small)
    rng = random.Random(small)
    for _ in range(600):
        k = rng.choice([1, 2, 3, 9])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(25))] for _ in range(2))
        s, i, d = alignment.edits(a, b)
        assert s + i + d == table(a, b)[-1][-1] and d - i == len(a) - len(b) and min(s, i, d) >= 0
    assert alignment.edits(list("abc"), list("axcd")) == (1, 1, 0) and alignment.edits([], ["a"]) == (0, 1, 0) and alignment.edits(["a"], []) == (0, 0, 1)


def test_word_errors_of_long_texts_with_many_different_words(spark):
    """More words than there are characters in 16 bits, and an edit of each kind."""
    rng = random.Random(5)
    ref = [f"w{k}" for k in range(100_000)]
    hyp = [("x" if rng.random() < 0.01 else w) for w in ref if rng.random() > 0.01]
    p = spark.createDataFrame([(" ".join(ref), " ".join(hyp)), (None, "a"), ("a b", None), ("A, b", "a B!")], "reference string, hypothesis string")
    long, *rest = evaluation.word_error_rate(p).collect()
    lost = len(ref) - len(hyp)
    assert long.words == 100_000 and long.deleted - long.inserted == lost and long.edits == lost + hyp.count("x") and long.wer == long.edits / 100_000
    assert [(r.words, r.substituted, r.inserted, r.deleted, r.wer) for r in rest] == [(0, 0, 1, 0, 1.0), (2, 0, 0, 2, 1.0), (2, 0, 0, 0, 0.0)]


def test_the_best_mapping_of_speakers():
    rng = np.random.default_rng(7)
    for _ in range(300):
        t = rng.integers(0, 12, (rng.integers(1, 6), rng.integers(1, 6))) * rng.integers(0, 2)
        g = t if t.shape[0] <= t.shape[1] else t.T
        assert alignment.best_mapping(t) == max(sum(g[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(g.shape[1]), g.shape[0]))


def brute_error(ref, hyp, collar=250):
    end = max([e for *_, e in ref + hyp], default=0) // 10 + 30
    frame = lambda x: max(x, 0) // 10
    r, h, scored = [None] * end, [None] * end, [True] * end
    for line, turns in ((r, ref), (h, hyp)):
        for who, s, e in turns:
            line[frame(s) : frame(e)] = [who] * (frame(e) - frame(s))
    for _, s, e in ref:
        for x in (s, e):
            scored[frame(x - collar) : frame(x + collar)] = [False] * len(scored[frame(x - collar) : frame(x + collar)])
    pairs = [(a, b) for a, b, ok in zip(r, h, scored, strict=True) if ok]
    both = [p for p in pairs if None not in p]
    us, them = sorted({a for a, _ in both}), sorted({b for _, b in both})
    best = max((sum((a, m.get(a)) in {(a, b)} for a, b in both) for m in (dict(zip(us, p, strict=False)) for p in itertools.permutations([*them, *[None] * len(us)], len(us)))), default=0)
    speech = sum(a is not None for a, _ in pairs)
    return speech, sum(a is not None and b is None for a, b in pairs), sum(a is None and b is not None for a, b in pairs), len(both) - best


def test_diarization_error_by_pieces_equals_frames(spark):
    rng, refs, hyps, want = random.Random(9), [], [], {}
    for rec in range(25):
        made = [[(rng.randrange(3), s := rng.randrange(-100, 6000), s + rng.randrange(0, 2500)) for _ in range(rng.randrange(1, 7))] for _ in range(2)]
        made[0].append((0, 0, 3000))
        for out, turns in zip((refs, hyps), made, strict=True):
            out += [(rec, k, *t) for k, t in enumerate(turns)]
        want[rec] = brute_error(*made)
    ddl = "rec_id long, turn_ord long, speaker int, start_ms long, end_ms long"
    got = {r.rec_id: (r.speech, r.miss, r.false_alarm, r.confusion) for r in evaluation.diarization_error(spark.createDataFrame(refs, ddl), spark.createDataFrame(hyps, ddl)).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(v[:3] == (0, 0, 0) for k, v in want.items() if k not in got)
    none = spark.createDataFrame([], ddl)
    assert evaluation.diarization_error(none, none).count() == 0


def test_thirty_speakers_a_side_and_a_long_recording(spark):
    ddl = "rec_id long, turn_ord long, speaker int, start_ms long, end_ms long"
    hours = [(1, k, k % 30, 10_000 * k, 10_000 * k + 10_000) for k in range(3000)]  # eight hours
    other = [(r, k, 29 - s, a, b) for r, k, s, a, b in hours]
    began = time.time()
    got = evaluation.diarization_error(spark.createDataFrame(hours, ddl), spark.createDataFrame(other, ddl)).first()
    assert (got.miss, got.false_alarm, got.confusion) == (0, 0, 0) and got.speech == 3000 * 950 + 25 - 25
    plan = evaluation._pieces(spark.createDataFrame(hours, ddl), spark.createDataFrame(other, ddl), 250)
    assert plan.count() < 20_000 and time.time() - began < 120  # pieces, not frames


def test_drift_equals_the_walk_of_its_rules(spark):
    def walk(b, o):
        far, i, j = [], 0, 0
        while i < len(b) and j < len(o):
            if b[i][0] == o[j][0]:
                far.append(abs(b[i][1] - o[j][1]))
                i, j = i + 1, j + 1
            elif b[i][0] in [w for w, _ in o[j + 1 : j + 4]]:
                j += 1
            elif o[j][0] in [w for w, _ in b[i + 1 : i + 4]]:
                i += 1
            else:
                i, j = i + 1, j + 1
        return sorted(far)

    rng, rows, want = random.Random(2), ([], []), {}
    for rec in range(20):
        words = [(rng.choice("abcdef"), 100 * k) for k in range(40)]
        other = [(w if rng.random() > 0.1 else "zz", t + rng.randrange(60)) for w, t in words if rng.random() > 0.15]
        for out, listed in zip(rows, (words, other), strict=True):
            out += [(rec, k, w, t) for k, (w, t) in enumerate(listed)]
        want[rec] = walk(words, other)
    b, o = (spark.createDataFrame(r, "rec_id long, seq long, word string, start_ms long") for r in rows)
    for r in evaluation.start_drift(b, o).collect():
        far = want.pop(r.rec_id)
        assert (r.matched, r.median, r.p95, r.most) == (len(far), far[(len(far) - 1) // 2], far[int((len(far) - 1) * 0.95)], far[-1])
    assert not any(want.values())


def test_windows_meet_their_own_recordings_speakers_only(spark):
    refs = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (2, "a", [0.0, 1.0])], "rec_id long, speaker string, embedding array<double>")
    w = spark.createDataFrame([(1, 1, "a", [1.0, 0.2]), (1, 2, "a", [0.2, 1.0]), (2, 1, "a", [0.2, 1.0]), (2, 2, "b", [0.0, 1.0]), (3, 1, "a", [1.0, 0.0]), (1, 3, "b", [0.7, 0.7])], "rec_id long, window long, speaker string, embedding array<double>")
    got = {(r.rec_id, r.window): r.own for r in reports.gate_by_speaker(w, refs).collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): True, (2, 2): False, (3, 1): False, (1, 3): True}
    plan = reports.gate_by_speaker(w, refs)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pieces_of_clean_speech(spark):
    c = spark.createDataFrame([(1, "a", 0, 6500), (1, "a", 10_000, 17_000), (1, "b", 0, 900), (1, "b", 1000, 1000)], "rec_id long, speaker string, s long, e long")
    got = sorted((r.speaker, r.piece, r.s, r.dur_ms) for r in spans.sample_pieces(c).collect())
    assert got == [("a", 0, 0, 6000), ("a", 1, 10_000, 6000), ("a", 2, 16_000, 1000), ("b", 0, 0, 900)]


def test_a_sample_is_put_together_from_the_nearest_pieces(spark):
    x = lambda *v: [float(k) for k in v]
    p = spark.createDataFrame([(1, "a", 0, 500, x(0, 1)), (1, "a", 1000, 1700, x(1, 0)), (1, "a", 5000, 5200, x(1, 0)), (1, "b", 0, 4000, x(1, 1)), (1, "c", 0, 299, x(1, 1)), (2, "a", 9, 1009, x(1, 0)), (2, "a", 2000, 3000, x(1, 0)), (2, "a", 4000, 5000, x(1, 0)), (2, "a", 6000, 9000, x(0, 1))], "rec_id long, speaker string, s long, e long, embedding array<double>")
    centre = p.select("rec_id", "speaker").distinct().withColumn("centroid", F.array(F.lit(1.0), F.lit(0.0)))
    got = [tuple(r) for r in spans.assemble_sample(p, centre).orderBy("rec_id", "speaker", "ord").collect()]
    assert got == [(1, "a", 0, 1000, 700), (1, "a", 1, 0, 500), (1, "a", 2, 1000, 700), (1, "a", 3, 0, 500), (1, "a", 4, 1000, 600), (1, "b", 0, 0, 3000), (2, "a", 0, 9, 1000), (2, "a", 1, 2000, 1000), (2, "a", 2, 4000, 1000)]


def test_windows_nearest_to_the_centroid_and_the_first_of_equals(spark):
    w = spark.createDataFrame([(1, "a", 500, [1.0, 0.0]), (1, "a", 250, [2.0, 0.0]), (1, "a", 0, [0.0, 1.0])], "rec_id long, speaker string, start_ms long, embedding array<double>")
    c = spark.createDataFrame([(1, "a", [1.0, 0.0])], "rec_id long, speaker string, centroid array<double>")
    assert [tuple(r) for r in spans.choose_sample(w, c).collect()] == [(1, "a", 250, 1.0)]


def test_dictionary_files_take_time_by_their_lines(spark):
    """Twice and eight times the lines in one file: far from the square."""
    def took(n):
        f = spark.createDataFrame([("f", "\n".join(f" phrase {k} " for k in range(n)))], "path string, content string")
        began = time.time()
        assert dictionaries.read_files(f)[0].count() == n
        return time.time() - began

    took(100)
    assert took(100_000) < 40


def test_dictionary_lines(spark):
    files = {"one": "terms, a,b", "late": "\n\nwords, a", "comment": "  # a, b", "crlf": "phrase\r\n a \r\nb", "hash": "a\n #b\nc#", "comma": "a,b\nc"}
    good, bad = dictionaries.read_files(spark.createDataFrame(list(files.items()), "path string, content string"))
    got = {}
    for r in good.orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append(r.phrase)
    assert got == {"one": ["a", "b"], "late": ["words", "a"], "crlf": ["a", "b"], "hash": ["a", "c#"], "comma": ["a,b", "c"]}
    assert [tuple(r) for r in bad.collect()] == [("comment", "no phrases")]


def test_every_language_has_a_name(spark):
    c = spark.createDataFrame([("uz",), ("pt-BR",), ("no",), ("??",), ("multi",)], "c string")
    name, _ = reports.language_name(F.col("c"), F.array("c"))
    assert [r[0] for r in c.select(name).collect()] == ["uzbek", "portuguese", "norwegian", "??", "multilingual"] and len(reports.LANGUAGES) == 41


def test_error_rate_of_sentences_with_many_words_and_with_none(spark, tmp_path):
    """The SQL is exact where more words meet than there are signs, and where a reference has no words."""
    duck = duckdb.connect()
    texts = [" ".join(f"w{k * 7 % 211}" for k in range(n)) + "." for n in (89, 95, 130, 300)] + ["Ah. - - - - -.", "a b c d e f. -.", "- ! -."]
    duck.execute("CREATE TABLE conversations AS SELECT i::BIGINT AS conv_id, 0::BIGINT AS turn, 'user' AS role, t AS text FROM (SELECT unnest(range(len(?::VARCHAR[]))) AS i, unnest(?::VARCHAR[]) AS t)", [texts, texts])
    duck.execute(f"COPY conversations TO '{tmp_path}/conversations.parquet' (FORMAT parquet)")
    want = sorted(duck.execute(plans.ORACLES["a17_word_error_rate"]).fetchall())
    assert sorted(tuple(r) for r in plans.QUERIES["a17_word_error_rate"](spark, str(tmp_path)).select("rec_id", "id", "words", "wer").collect()) == want
