"""Quality classifier from positive and unlabelled texts: the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewords.llm.common import batches, by_document, give_back, held_out, read, record, texts, utf8
from tidewords.llm.ngrams import histograms

BINS, SIZES, HIDDEN = 512, (1, 2, 3), 24
#: Bounds of the training sample, in documents.
POSITIVES, UNLABELLED = 4000, 8000
EPOCHS, BATCH, RATE, DECAY = 30, 256, 2e-3, 1e-4
THRESHOLD = 0.3
# Shapes: letters a or A, digits 0; other ASCII as it is; bytes of longer characters are letters.
_TABLE = np.array([97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)], np.uint32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, (x - self.mean) / self.scale)[1], -30, 30)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.tanh(x @ w1 + b1)
    return h, h @ w2 + b2[0]


def features(batch: pa.RecordBatch) -> np.ndarray:
    """Shares of hashed shape n-grams (square roots), length, and how well the text compresses for its length."""
    raw, at = utf8(batch.column("text"))
    lens = np.diff(at).astype(np.float32)
    zstd = zstandard.ZstdCompressor(level=1)
    packed = np.array([len(zstd.compress(t)) for t in texts(batch)], np.float32)
    plain = np.column_stack((np.log1p(lens), np.log(packed), np.log1p(lens) - np.log(packed)))
    return np.hstack((np.sqrt(histograms(raw, at, _TABLE, BINS, SIZES)), plain)).astype(np.float32)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 11, weighed: bool = False) -> Model:
    """Adam on the non-negative risk  prior E_p l(g) + max(0, E_u l(-g) - prior E_p l(-g))  with logistic loss.

    Where the part in max() is negative in a batch, the step goes up its gradient instead, so that the model
    doesn't gain by taking trusted positives for negatives. With ``weighed`` the positives aren't taken out of the
    unlabelled: plain classification of the one against the other, both of equal weight.
    """
    random = np.random.default_rng(seed)
    both = np.vstack((positive, unlabelled))
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    d = both.shape[1]
    layers = [random.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(EPOCHS):
        op, ou = random.permutation(len(p)), random.permutation(len(u))
        steps = max(1, -(-len(u) // BATCH))
        for part_p, part_u in zip(np.array_split(op, steps), np.array_split(ou, steps), strict=True):
            if not len(part_p) or not len(part_u):
                continue
            x = np.vstack((p[part_p], u[part_u]))
            n, m = len(part_p), len(part_u)
            h, g = _forward(layers, x)
            up = -sigmoid(-g[:n]) * prior / n  # of the positives' loss as positives
            down_p, down_u = -sigmoid(g[:n]) * prior / n, sigmoid(g[n:]) / m  # of the negatives' risk
            negative = np.logaddexp(0, g[n:]).mean() - prior * np.logaddexp(0, g[:n]).mean()
            if weighed:
                dg = np.concatenate((up, down_u * 0.5))
            else:
                dg = np.concatenate((up + down_p, down_u)) if negative >= 0 else -np.concatenate((down_p, down_u))
            dh = np.outer(dg, layers[2]) * (1 - h * h)
            t += 1
            for k, grad in enumerate((x.T @ dh, dh.sum(0), h.T @ dg, np.array([dg.sum()]))):
                grad = grad + DECAY * layers[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, layers, prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 13) -> float:
    """The share of positives among the unlabelled rows, from the rows alone: the best bin of a ranking.

    A classifier of positives against unlabelled, fitted on one half, ranks the other half. Above any score the
    share of unlabelled rows over that of positives is the prior plus what negatives there are; its least upper
    bound (with a margin for the sample, and over at least a tenth of the positives) is the estimate. Both halves
    serve by turns; inside 0.05 to 0.95.
    """
    random = np.random.default_rng(seed)
    p, u = (x[random.permutation(len(x))] for x in (positive, unlabelled))
    found = []
    for k in (0, 1):
        model = fit(p[k::2], u[k::2], 0.5, seed, weighed=True)
        own, other = np.sort(model.score(p[1 - k :: 2])), np.sort(model.score(u[1 - k :: 2]))
        if not len(own) or not len(other):
            continue
        at = own[: max(1, int(0.9 * len(own)))]
        above_p, above_u = 1 - np.searchsorted(own, at) / len(own), 1 - np.searchsorted(other, at) / len(other)
        margin = np.sqrt(np.log(40) / 2) * (len(own) ** -0.5 + len(other) ** -0.5)
        best = np.argmin((above_u + margin) / above_p)
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), 0.05, 0.95)) if found else 0.5


def _sample_features(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, 2 << 20):
        yield pa.RecordBatch.from_arrays([batch.column("trusted"), pa.array([r.tobytes() for r in features(batch).astype(np.float16)], pa.binary())], ["trusted", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from documents that aren't held out: trusted positives and unlabelled texts; None without either.

    Of the labels only quality 1 is read; the class prior is estimated from the two samples (``class_prior``).
    Both samples are bounded (``POSITIVES``, ``UNLABELLED``) and chosen by a hash of the id. Labels that are
    null or repeated count once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("__quality"))
    good = known.where("__quality = 1").count()
    free = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    total = free.select("doc_id").count()
    if not good or not total:
        return None
    at = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    trusted = known.where(F.col("__quality") == 1).where(at("trusted") < POSITIVES / good).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(True).alias("trusted")).limit(2 * POSITIVES)
    picked = free.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (at("unlabelled") < UNLABELLED / total).alias("free")).join(F.broadcast(trusted), "doc_id", "left").where("free or trusted")
    rows = picked.select(F.explode(F.expr("filter(array(trusted, if(free, false, null)), x -> x is not null)")).alias("trusted"), "text").mapInArrow(_sample_features, "trusted boolean, x binary").toArrow()
    pairs = sorted(zip(rows["trusted"].to_pylist(), rows["x"].to_pylist(), strict=True))  # the same order at every run
    kind = np.array([k for k, _ in pairs], bool)
    if not kind.any() or kind.all():
        return None
    x = np.stack([np.frombuffer(b, np.float16) for _, b in pairs]).astype(np.float32)
    return fit(x[kind], x[~kind], class_prior(x[kind], x[~kind]))


def _scorer(model: Model | None, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 2 << 20):
            score = model.score(features(batch)).astype(np.float64) if model else np.full(batch.num_rows, 0.5)
            yield record(schema, doc_id=batch.column("doc_id"), score=score)

    return run


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for each row, from its whole text alone; null counts as empty, and empty texts score too.

    Without a model every score is 0.5. Null ids and ids of any type stay; repeated rows score alike; other columns go;
    an empty table gives no rows.
    """
    fields, schema = by_document(docs, "score double")
    return docs.select("doc_id", "text").mapInArrow(_scorer(model, schema), fields)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; see ``score_documents`` for nulls, empty texts and repeated rows."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; null and empty texts are scored as such."""
    from pyspark.sql.types import DoubleType

    model = train(docs, read(spark, sf_dir, "labels"))

    @F.arrow_udf(DoubleType())
    def score(text: pa.Array) -> pa.Array:
        if not len(text):
            return pa.array([], pa.float64())
        parts = batches(iter([pa.RecordBatch.from_arrays([text], ["text"])]), 2 << 20)
        scores = np.concatenate([model.score(features(b)) if model else np.full(b.num_rows, 0.5) for b in parts])
        give_back()
        return pa.array(scores.astype(np.float64))

    return docs.where(score("text") >= THRESHOLD)
