"""Each numbered operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns and string ids."""

import collections
import hashlib
import random
import string
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewords.llm import bpe, common, jpeg, language, lm, mixing, quality, rules, secrets, sharding, simhash

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that operators use inside, and those that they add.
CLASHING = ["size", "shard", "slot", "hash", "range", "cell", "row", "rank", "before", "before_class", "before_cell", "before_range", "__cell", "__id", "__rules", "__print", "__src", "id", "key", "spans", "print", "mark", "place", "copies", "taken", "target", "source_size", "trusted", "block", "part", "media"]
ROWS = [("b", None, None, None), ("a", "", "en", "s"), ("c", "one two three four five", "en", "s"), ("c", "one two three four five", "en", "s"), (None, "é " * 300, None, "t"), (None, "é " * 300, None, "t"), ("d", " \n ", "fr", None), ("e", "token: abcdefgh", "de", "t")]


@pytest.fixture()
def odd(spark):
    df = spark.createDataFrame([(*r, None) for r in ROWS], "doc_id string, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("kept") for c in CLASHING})


OPERATORS = {
    "jpeg": (jpeg.to_jpeg, False),
    "thumbnails": (lambda d: jpeg.jpeg_thumbnails(jpeg.to_jpeg(d)), False),
    "simhash": (simhash.simhash_groups, False),
    "language": (lambda d: language.identify(d, None), False),
    "mixing": (mixing.mix_sources, True),
    "secrets": (lambda d: secrets.find_secrets(d).select("row.*", F.col("spans").alias("found")), True),
    "redact": (secrets.redact, True),
    "encode": (lambda d: bpe.encode_documents(d, PATH), False),
    "backoff": (lm.backoff_scores, False),
    "rules": (rules.quality_rules, False),
    "quality": (lambda d: quality.score_documents(d, None), False),
    "sharding": (sharding.shard_documents, True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_rows_ids_and_columns(odd, name):
    run, wide = OPERATORS[name]
    got = run(odd)
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in ROWS)
    assert not wide or all(r[c] == "kept" for r in got.collect() for c in CLASHING if c not in (*mixing.ADDED, "size", "shard", "slot"))
    assert run(odd.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, odd):
    """Near-duplicates go (all without words are alike), copies of mixed rows are whole rows, and no stage minds empty tables."""
    kept = simhash.stage(spark, odd, "")
    assert kept.columns == odd.columns and len(kept.collect()) == 4 and [r.doc_id for r in kept.collect()].count("c") == 1
    assert secrets.stage(spark, odd, "").where("doc_id = 'e'").first().text == "[secret]"
    assert {r.key for r in mixing.stage(spark, odd, "").collect()} <= {"kept"}
    for stage in (simhash.stage, secrets.stage, mixing.stage, bpe.stage):
        assert stage(spark, odd.limit(0), "").count() == 0
    left = quality.stage(spark, odd, SMALL)
    assert left.columns == odd.columns


def test_media_digests_match_hashlib(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in jpeg.op1_media(spark, SMALL).collect():
        whole = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 if texts[r.doc_id] else 64)
        image = jpeg.encode_payloads(*common.utf8(pa.array([texts[r.doc_id].decode()])))[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())


def test_long_texts_go_in_parts():
    """A text of some megabytes: its image, its fingerprint and its repeated words are those of the whole."""
    r = random.Random(4)
    words = ["".join(r.choices(string.ascii_letters, k=r.randint(1, 9))) for _ in range(3000)]
    text = " ".join(r.choices(words, k=900_000))
    raw, at = common.utf8(pa.array([text]))
    assert len(raw) > jpeg.ENCODE_BYTES
    d = jpeg.decode(jpeg.encode_payloads(raw, at), keep=True)[0]
    assert jpeg.payload(d)[1][: len(raw)] == text.encode()
    both, ends = common.utf8(pa.array([text, "x"]))
    assert jpeg.encode_payloads(both, ends)[0] == jpeg.encode_payloads(raw, at)[0]
    low = text.lower().split()
    hashes = np.array([common_hash(" ".join(low[i : i + 4])) for i in range(len(low) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    n = collections.Counter(zip(words_ := text.split(), words_[1:], words_[2:]))
    again = {i + k for i in range(len(words_) - 2) if n[words_[i], words_[i + 1], words_[i + 2]] > 1 for k in range(3)}
    old, rules.WINDOWS = rules.WINDOWS, 1 << 17
    try:
        assert rules.repeat_words(*common.words(raw, at), 1).tolist() == [len(again)]
    finally:
        rules.WINDOWS = old


def common_hash(text):
    import xxhash

    return xxhash.xxh64_intdigest(text.encode(), 42)


def test_verdicts_match_a_plain_reading(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    zstd = zstandard.ZstdCompressor(level=3)
    ratio = lambda b: len(b) / len(zstd.compress(b))

    def bad(b):
        low, high = [(low, high) for least, low, high in rules.BANDS if len(b) >= least][-1]
        return not low <= ratio(b) <= high

    got = rules.op8_rules(spark, "/root/testdata/sf0.01").collect()
    for r in got:
        b = docs[r.doc_id]
        parts = [p for k in range(0, len(b), 4096) if len(p := b[k : k + 4096]) >= 1024] if len(b) > 4096 else [b]
        share = sum(len(p) for p in parts if bad(p)) / max(1, sum(map(len, parts)))
        assert r.kept == (not r.base_failed and not bad(b) and share <= rules.BAD_SHARE)
    assert any(not r.kept and not r.base_failed for r in got)


def test_repeated_passages_fall_at_each_length(spark):
    r = random.Random(9)
    clean = [x.text for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if x.text and len(x.text) > 1500]
    docs = []
    for n in (1500, 3000, 6000, 12_000, 40_000, 200_000):
        part = clean[r.randrange(len(clean))].split()[:70]
        docs.append((len(docs), " ".join(part * (n // 300))[:n]))
    got = rules.quality_rules(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert not any(x.kept for x in got)


def plain_language(m, text):
    """The model's forward pass by plain loops over the bytes."""
    table = {c: c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)}
    code = [table[c] for c in text.encode()] + [32, 32]
    shares = np.zeros(language.BINS)
    primes = [0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F]
    shift = 32 - language.BINS.bit_length() + 1
    for size in language.SIZES:
        for i in range(len(code) - 2):
            h = size * 0x01000193 % (1 << 32)
            for k in range(size):
                h = (h ^ (code + [32] * 4)[i + k]) * primes[k] % (1 << 32)
            shares[h >> shift] += 1
    z = (shares / max(1, len(text.encode()) * len(language.SIZES))) @ m.embeddings @ m.weights + m.bias
    p = np.exp(z / m.temperature - (z / m.temperature).max())
    return p / p.sum()


def test_language_forward_pass_gradient_and_calibration(spark):
    random_ = np.random.default_rng(3)
    x, y = random_.random((12, language.BINS)).astype(np.float32) / 50, random_.integers(0, 3, 12)
    m = language.Model(["a", "b", "c"], random_.normal(0, 1, (language.BINS, language.DIM)), random_.normal(0, 1, (language.DIM, 3)), random_.normal(0, 1, 3))
    weight = np.array([1.0, 2.0, 0.5])
    loss = lambda: -(weight[y] * np.log(language.softmax(m.logits(x))[np.arange(12), y])).mean()
    for values, grad in zip((m.embeddings, m.weights, m.bias), language.gradient(m, x, y, weight), strict=True):
        at = np.unravel_index(int(np.abs(grad).argmax()), grad.shape)
        values[at] += 1e-4
        up = loss()
        values[at] -= 2e-4
        assert abs((up - loss()) / 2e-4 - grad[at]) < 1e-4 * max(1, abs(grad[at]))
        values[at] += 1e-4
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    some = docs.where("length(text) < 400").limit(12).collect()
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for r in some:
        p = plain_language(model, r.text)
        if any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == model.languages[int(p.argmax())] and abs(got[r.doc_id].score - p.max()) < 1e-4
    noise = spark.createDataFrame([(i, "".join(random.Random(i).choices("qxzjwvk", k=60))) for i in range(40)], "doc_id long, text string")
    assert language.identify(noise, model).where("rejected").count() > 20


def test_unbiased_risk_and_class_prior():
    """With known classes the estimated prior is near, and the classifier parts them."""
    random_ = np.random.default_rng(5)
    good = lambda n: random_.normal(1.5, 1, (n, 4))
    poor = lambda n: random_.normal(-1.5, 1, (n, 4))
    for share in (0.3, 0.8):
        unlabelled = np.vstack((good(int(2000 * share)), poor(int(2000 * (1 - share)))))
        prior = quality.class_prior(good(1000), unlabelled)
        assert abs(prior - share) < 0.1
        model = quality.fit(good(1000), unlabelled, prior)
        assert (model.score(good(500)) > 0.5).mean() > 0.95 and (model.score(poor(500)) < 0.5).mean() > 0.9


def test_quality_scores_are_the_plain_forward_pass(spark):
    model = quality.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = ["", "Plain words, and more of them.", "###$$$ ### 000"]
    x = quality.features(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    w1, b1, w2, b2 = model.layers
    for row, score in zip(x, model.score(x), strict=True):
        z = [(float(v) - float(m)) / float(s) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        hidden = [np.tanh(sum(a * b for a, b in zip(z, w1[:, k], strict=True)) + b1[k]) for k in range(len(b1))]
        assert abs(1 / (1 + np.exp(-np.clip(sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0], -30, 30))) - score) < 1e-5


@pytest.mark.parametrize("shards", [3, 24])
def test_shards_reach_the_least_capacity_over_equal_texts(spark, shards, monkeypatch):
    """Also where first ranges are so coarse that they are cut finer several times."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = collections.Counter()
    for r in docs.collect():
        t = (r.text or "").encode()
        sizes[hashlib.md5(t).hexdigest()] += len(t) + 8
    want = sharding.smallest_capacity(np.array([sizes[h] for h in sorted(sizes)]), shards)
    for digits in (1, 4):
        monkeypatch.setattr(sharding, "RANGE_DIGITS", digits)
        got = sharding.shard_documents(docs, shards).groupBy("shard").agg(F.sum("size").alias("b")).collect()
        assert max(r.b for r in got) == want and len(got) == shards


def test_links_are_the_same_by_two_segments_or_three(spark):
    random_ = np.random.default_rng(2)
    base = random_.integers(-(1 << 62), 1 << 62, 60)
    near = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in random_.integers(0, 62, (6, 2))} | set(map(int, base))
    prints = spark.createDataFrame([(p,) for p in near], "print long")
    groups = lambda parts: {(r.node, r.root) for r in simhash.components(simhash.near_links(prints, parts)).collect()}
    assert groups(2) == groups(3) == groups(1) and groups(2)


def test_secrets_of_many_hits_take_no_square_of_time(spark):
    """Four times the hits: sixteen times as long, were it the square."""
    import time

    def took(n):
        text = " ".join(f"password={'x' * 8}{i}" for i in range(n))
        began = time.time()
        row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
        assert len(row.spans) == n and row.spans[-1].end == len(text)
        return time.time() - began

    took(100)
    assert took(40_000) < 10 * max(took(10_000), 1)


def test_backoff_blocks_take_little_memory():
    """Two workers stand beside an executor's JVM, so a block's n-grams and scores take 13 bytes a byte of text (27.8 with all places at once)."""
    words = np.random.default_rng(7).integers(10_000, 60_000, 300_000).astype(str)
    joined = " ".join(words).encode()
    raw, at, flags = np.frombuffer(joined, np.uint8), np.array([0, 6 * 200_000, len(joined)]), np.zeros(2, bool)
    lm.Grams(raw, at, flags, flags)
    tracemalloc.start()
    try:
        n_words, total = lm.Grams(raw, at, flags, flags).sums(lm.BACKOFF, lm.LEAST)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n_words.tolist() == [200_000, 100_000] and (total < 0).all()
    assert peak < 20 * len(joined)


def test_backoff_blocks_leave_in_small_batches():
    joined = " ".join(np.random.default_rng(8).integers(10_000, 60_000, 150_000).astype(str)).encode()
    block = pa.RecordBatch.from_pylist([{"block": 5, "at": [0, len(joined)], "led": False, "open": False, "packed": lm._pack(joined)}])
    out = list(lm._ask(8)(iter([block])))
    sizes = [len(b.column("counts").flatten()) for b in out]
    assert len(out) > 1 and max(sizes) <= lm.SLICE
    parts = [p for b in out for p in b.column("part").to_pylist()]
    grams = lm._grams(block, 0)
    assert parts == np.unique(grams.ranges(8)[0]).tolist() and {b for x in out for b in x.column("block").to_pylist()} == {5}
    assert np.concatenate([b.column("counts").flatten().to_numpy() for b in out]).tolist() == grams.counts.tolist()
