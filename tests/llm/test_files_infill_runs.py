"""Token files, fill-in-middle and runs against plain readings, on odd rows and on whole tables."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewords.llm import common, infill, queries, runs, tokenfiles

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [("b", None), ("a", ""), ("c", "One two\nthree"), ("c", "One two\nthree"), (None, "é ’s \n" * 400), (None, "é ’s \n" * 400), ("d", " \n "), ("e", "a<S>b\n"), ("f", "\n\n\n"), ("g", "x" * 70_000 + " \v\f y\x1cz　w İΣ <|endoftext|>")]


@pytest.fixture()
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id string, text string")
    return df.withColumns({c: F.lit("kept") for c in ("n", "form", "h1", "digest", "ids", "at", "part", "start", "mark", "runs", "found", "a", "p", "output")})


@pytest.mark.parametrize("name", ["op12_infill", "op13_runs"])
def test_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    asked = c.execute(queries.ORACLES[name] + " ORDER BY doc_id")
    columns = [x[0] for x in asked.description]
    assert [tuple(r) for r in got.select(*columns).orderBy("doc_id").collect()] == asked.fetchall()


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_token_files_hold_the_library_s_ids_of_whole_texts(spark):
    docs = pq.read_table(f"{MIDDLE}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    want, start = [], 0
    for doc_id, ids in zip(docs["doc_id"].to_pylist(), library_ids(docs["text"].to_pylist()), strict=True):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in tokenfiles.op11_token_files(spark, MIDDLE).orderBy("doc_id").collect()] == want


def test_pieces_have_the_library_s_ids_in_any_text():
    rng = random.Random(4)
    signs = ["a", "B", "é", "É", "'", "'s", "'LL", "\u2019", ".", "--", "7", "٣", " ", "\t", "\u00a0", "\u3000", "H\u0331", "I\u0307", "Σ", "ǅ", "\u0301", "日", "𝄞", "<", "|", ">", "\x00", "\x1c", "_"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3000)] + ["x<|endoftext|>y Z", "A<|ENDOFTEXT|>"]
    raw = Path(TOKENIZER).read_bytes()
    for part in (texts[:-2], texts):  # the last ones hold what may be special tokens
        ids, at = tokenfiles.WordEncoder(raw).encode(*common.utf8(pa.array(part)))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == library_ids(part)


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    path = str(tmp_path / "t")
    tokenfiles.write_tokens(odd, path, TOKENIZER)
    kind = odd.schema["doc_id"].dataType
    held = tokenfiles.read_documents(spark, path, F.lit(True), kind).collect()
    assert sorted((r.doc_id or "", list(r.ids)) for r in held) == sorted((i or "", ids) for (i, _), ids in zip(ODD, library_ids(t for _, t in ODD), strict=True))
    index = tokenfiles.read_index(spark, path, kind).orderBy("start").collect()
    assert [r.doc_id for r in index] == sorted((i for i, _ in ODD), key=lambda i: i or "")
    assert [r.start for r in index] == np.concatenate(([0], np.cumsum([r.n_tokens for r in index])))[:-1].tolist()
    assert {(r.start, r.n_tokens) for r in index} == {(r.start, r.n_tokens) for r in tokenfiles.read_checksums(spark, path, kind).collect()}
    none = str(tmp_path / "none")
    tokenfiles.write_tokens(odd.limit(0), none, TOKENIZER)
    assert tokenfiles.read_checksums(spark, none, kind).count() == 0


def test_token_files_have_dictionaries_deltas_and_small_pages_with_an_index(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    tokenfiles.write_tokens(docs, path, TOKENIZER, row_group=1 << 18)
    files = sorted(Path(path).glob("part-*.parquet"))
    groups = [f.metadata.row_group(k) for f in map(pq.ParquetFile, files) for k in range(f.metadata.num_row_groups)]
    assert len(groups) > len(files)
    for group in groups:
        doc_id, at, n, ids = (group.column(k) for k in range(4))
        assert all("DELTA_BINARY_PACKED" in c.encodings and not c.has_dictionary_page for c in (doc_id, at, n))
        assert ids.has_dictionary_page and all(group.column(k).has_offset_index for k in range(4)) and doc_id.has_column_index
    some = tokenfiles.read_documents(spark, path, F.col("doc_id").between(10, 12))
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and some.count() == 3
    counts = tokenfiles.read_index(spark, path)._jdf.queryExecution().toString()
    assert "ids" not in "".join(re.findall(r"ReadSchema: [^\n]*", counts))


def brute_infill(doc_id, text):
    text = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{doc_id or ''}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    low, high = sorted((a % (len(u) + 1), b % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if not text or re.search("<[PSM]>", text):
        return len(u), "plain", None, None, text
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < 50 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_of_odd_rows(spark, odd):
    rng = random.Random(3)
    more = [(f"r{k}", "".join(rng.choices(["a", "é", "\n", "日", "<", "P>", "\r", "𝄞"], k=rng.randrange(40)))) for k in range(300)]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id string, text string"))
    made = infill.fill_in_middle(rows).withColumn("back", infill.restore(F.col("output"), F.col("form")))
    got = sorted((r.doc_id or "", r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect())
    assert got == sorted((i or "", *brute_infill(i, t), t or "") for i, t in [*ODD, *more])
    assert infill.fill_in_middle(odd.limit(0)).count() == 0
    assert {r.form for r in infill.fill_in_middle(odd, rate=0).collect()} == {"plain"}
    marked = infill.fill_in_middle(odd, marks=("[p.", "[s.", "[m."), suffix_first=100)
    assert {r.form for r in marked.where("doc_id IN ('c', 'e')").collect()} == {"spm"}
    assert marked.where(infill.restore(F.col("output"), F.col("form"), ("[p.", "[s.", "[m.")) == "a<S>b\n").count() == 1


def test_bytes_are_marked_counted_and_found():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 9, 64, 1001):
        raw = rng.choice(np.array([9, 10, 11, 138, 0, 255, 200, 128], np.uint8), n)
        marked = infill.Marked(infill.equal_to(infill.words_of(raw), 10))
        places = np.flatnonzero(raw == 10)
        assert (marked.rank(np.arange(n + 1)) == np.concatenate(([0], np.cumsum(raw == 10)))).all()
        assert (marked.select(np.arange(len(places))) == places).all()
        inner = infill.Marked(infill.continued(infill.words_of(raw)))
        assert inner.rank(np.array([n])) == (raw & 0xC0 == 0x80).sum()


def brute_runs(w, least=6, power=4):
    out, n = {}, len(w)
    for q in range(1, n // power + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                out.setdefault((i, j - i + q), q)  # the smallest period first
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in out.items())


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and len(w) > 8:
            p, a = rng.randint(1, 6), rng.randrange(len(w))
            w = [w[i if i < a else a + (i - a) % p if a + (i - a) % p < len(w) else 0] for i in range(len(w))]
        for power in (2, 3, 4):
            assert runs.runs_of(w, 6, power) == brute_runs(w, 6, power)


def test_stretches_hold_all_runs():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randrange(50) for _ in range(80)] + [k % 5 for k in range(30)] + [rng.randrange(50) for _ in range(40)] + [1] * 6
        doc = np.repeat([0, 1], [len(w), len(w)])
        codes = np.array(w + w)
        found = sorted((a + s, n, q) for a, b in runs.stretches(codes, doc) for s, n, q in runs.runs_of(codes[a:b].tolist()))
        assert found == sorted((k + s, n, q) for k in (0, len(w)) for s, n, q in brute_runs(w))


def test_runs_of_odd_rows(spark, odd):
    loops = [("l", "x " + "a b c " * 5 + "a y"), ("l", "x " + "a b c " * 5 + "a y"), ("o", "z " * 6), ("o2", "z " * 5), ("n", ("p q p r " * 4 + "s ") * 4)]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame(loops, "doc_id string, text string"))
    got = {r.doc_id: r for r in runs.collapse_runs(rows).collect()}
    assert runs.collapse_runs(rows).count() == rows.count() and runs.collapse_runs(odd.limit(0)).count() == 0
    assert got["b"].n_words == got["a"].n_words == 0 and got["b"].collapsed == "" and got["b"].runs == []
    assert [tuple(r) for r in got["l"].runs] == [(1, 16, 3)] and got["l"].collapsed == "x a b c y"
    assert [tuple(r) for r in got["o"].runs] == [(0, 6, 1)] and got["o2"].runs == []
    for doc_id, text in rows.collect():
        if doc_id in ("n", "c", "g"):
            assert [tuple(r) for r in got[doc_id].runs] == brute_runs(re.findall(r"[^\x20\x09-\x0D]+", text))
    with pytest.raises(ValueError):
        runs.collapse_runs(odd, power=1)
    with pytest.raises(ValueError):
        tokenfiles.WordEncoder(Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes())
