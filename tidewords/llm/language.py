"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.llm.common import batches, by_document, held_out, read, record, texts, utf8
from tidewords.llm.ngrams import histograms

BINS, DIM, SIZES = 2048, 16, (2, 3)
#: Bounds of the training sample, in documents: of one language, and in all.
PER_LANGUAGE, IN_ALL = 1500, 12_000
EPOCHS, BATCH, RATE, SNIPPET = 12, 64, 20.0, 96
#: Share of right predictions that rejection may cost on the calibration part.
COST = 0.01
_LETTER = regex.compile(r"\p{L}")
# Letters and bytes of longer characters stay, A-Z in lower case; all else is a blank.
_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, shares: np.ndarray) -> np.ndarray:
        return shares @ self.embeddings @ self.weights + self.bias

    def predict(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(shares) / self.temperature)
        return p.argmax(1), p.max(1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return histograms(raw, offsets, _TABLE, BINS, SIZES)


def gradient(m: Model, xs: np.ndarray, ys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean weighted cross-entropy, by embeddings, weights and bias."""
    h = xs @ m.embeddings
    d = softmax(h @ m.weights + m.bias)
    d[np.arange(len(ys)), ys] -= 1
    d *= weight[ys][:, None] / len(ys)
    return xs.T @ (d @ m.weights.T), h.T @ d, d.sum(0)


def fit(x: np.ndarray, y: np.ndarray, kept_back: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent on the rows that aren't kept back; temperature and threshold on those that are."""
    random = np.random.default_rng(seed)
    k = len(languages)
    m = Model(languages, random.normal(0, 0.1, (BINS, DIM)).astype(np.float32), random.normal(0, 0.3, (DIM, k)).astype(np.float32), np.zeros(k, np.float32))
    held, used = np.flatnonzero(kept_back), np.flatnonzero(~kept_back)
    weight = (len(used) / k / np.maximum(1, np.bincount(y[used], minlength=k))).astype(np.float32)
    for epoch in range(EPOCHS):
        random.shuffle(used)
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(used), BATCH):
            some = used[a : a + BATCH]
            by_embedding, by_weight, by_bias = gradient(m, x[some], y[some], weight)
            m.weights -= rate * 0.05 * by_weight
            m.bias -= rate * 0.05 * by_bias
            m.embeddings -= rate * by_embedding
    if len(held):
        z = m.logits(x[held])
        loss = {t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        m.temperature = float(min(loss, key=loss.get))
        best, score = m.predict(x[held])
        if (right := np.sort(score[best == y[held]])).size:
            m.threshold = float(right[int(COST * (len(right) - 1))])
    return m


def _sample_features(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the whole text and one for its first words, so that short texts are learnt as well."""
    for batch in batches(source, 2 << 20):
        whole = texts(batch)
        both = whole + [t[:SNIPPET] for t in whole]
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, both), np.int64, len(both)))))
        x = features(np.frombuffer(b"".join(both), np.uint8), offsets).astype(np.float16)
        lang, back = (pa.concat_arrays([batch.column(c)] * 2) for c in ("lang", "back"))
        yield pa.RecordBatch.from_arrays([lang, back, pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "back", "x"])


def train(docs: DataFrame) -> Model | None:
    """A model from a bounded sample of documents that aren't held out and have a language; None without any.

    The sample has at most about ``PER_LANGUAGE`` documents a language and ``IN_ALL`` in all, chosen by a hash
    of the id, so it is the same at every run. A fifth of its documents, by another hash, is kept back for temperature
    and threshold; so no text is in both parts. There must be few enough languages for a softmax over them.
    """
    taught = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in taught.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = {k: min(1.0, min(PER_LANGUAGE, IN_ALL / len(counts)) / n) for k, n in counts.items()}
    at = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    sample = taught.where(at < F.create_map(*(F.lit(v) for kv in share.items() for v in kv))[F.col("lang")])
    back = (F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(5)) == 0).alias("back")
    rows = sample.select("lang", back, "text").mapInArrow(_sample_features, "lang string, back boolean, x binary").toArrow()
    languages = sorted(counts)
    known = sorted(zip(rows["lang"].to_pylist(), rows["x"].to_pylist(), rows["back"].to_pylist(), strict=True))  # the same order at every run
    x = np.stack([np.frombuffer(b, np.float16) for _, b, _ in known]).astype(np.float32) if known else np.zeros((0, BINS), np.float32)
    return fit(x, np.array([languages.index(v) for v, *_ in known], np.int64), np.array([k for *_, k in known], bool), languages)


def _predictor(model: Model | None, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 2 << 20):
            n = batch.num_rows
            lettered = np.fromiter((_LETTER.search(t) is not None for t in (v or "" for v in batch.column("text").to_pylist())), bool, n)
            best, score = model.predict(features(*utf8(batch.column("text")))) if model else (np.zeros(n, int), np.zeros(n))
            names = np.array([*(model.languages if model else ["und"]), "und"], object)
            known = lettered if model else np.zeros(n, bool)
            score = np.where(known, score, 0.0).astype(np.float64)
            yield record(schema, doc_id=batch.column("doc_id"), lang_pred=names[np.where(known, best, -1)].tolist(), score=score, rejected=~known | (score < (model.threshold if model else 1)))

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs``, from its whole text.

    A text that is null or has no letters is ``und`` with score 0 and rejected; so is any without a model.
    ``rejected`` marks scores below the calibrated threshold. Null ids and ids of any type stay; repeated rows are
    predicted alike; other columns go; an empty table gives no rows.
    """
    fields, schema = by_document(docs, "lang_pred string, score double, rejected boolean")
    return docs.select("doc_id", "text").mapInArrow(_predictor(model, schema), fields)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents; see ``identify`` for nulls, empty texts and repeated rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
