"""Queries over signals and speaker vectors; floating results are rounded to six places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewords.functions import scalar as f
from tidewords.operators import signals as op
from tidewords.plans.registry import query
from tidewords.sources import derived as d

_SAMPLES = f"WITH {d.SAMPLES_SQL}"
#: Eight signals one after the other make a recording that is long enough for a noise floor, and quiet enough.
_LONG = f"{_SAMPLES}, long AS (SELECT rec_id // 8 AS rec_id, rec_id % 8 * 64 + idx AS idx, v / 100 AS v FROM samples)"
_BINS = f"{_LONG}, bins AS (SELECT rec_id, idx // 2 AS bin, avg(v * v) AS power FROM long GROUP BY ALL HAVING count(*) = 2)"
_BLOCKS = f"{_BINS}, blocks AS (SELECT rec_id, bin // 5 AS block, avg(power) AS power FROM bins GROUP BY ALL HAVING count(*) = 5)"
_PAIRS = f"{_SAMPLES}, pairs AS (SELECT a.rec_id // 2 AS rec_id, a.idx, a.v AS r, b.v AS e FROM samples a JOIN samples b ON b.rec_id = a.rec_id + 1 AND b.idx = a.idx WHERE a.rec_id % 2 = 0)"


def _long(spark, sf_dir):
    return d.samples(spark, sf_dir).select(F.floor(F.col("rec_id") / 8).alias("rec_id"), (F.col("rec_id") % 8 * 64 + F.col("idx")).alias("idx"), (F.col("v") / 100).alias("v"))


def _bins(spark, sf_dir):
    return op.energy_bins(_long(spark, sf_dir), 2)


def _pairs(spark, sf_dir):
    """Two signals in a row as a reference r and an estimate e."""
    side = lambda k: F.max(F.when(F.col("rec_id") % 2 == k, F.col("v")))
    return d.samples(spark, sf_dir).groupBy(F.floor(F.col("rec_id") / 2).alias("rec_id"), "idx").agg(side(0).alias("r"), side(1).alias("e")).where("r IS NOT NULL AND e IS NOT NULL")


@query("s7_explode_signal", f"{_SAMPLES} SELECT rec_id, count(*) AS n, count(*) / 16000 AS seconds FROM samples GROUP BY rec_id")
def _(spark, sf_dir):
    return d.samples(spark, sf_dir).groupBy("rec_id").agg(F.count("*").alias("n"), (F.count("*") / 16000).alias("seconds"))


@query(
    "a10_waveform_peaks",
    f"{_SAMPLES}, c AS (SELECT *, count(*) OVER (PARTITION BY rec_id) AS n FROM samples), b AS (SELECT rec_id, idx * 10 // n AS bucket, sqrt(avg(v * v)) AS rms FROM c GROUP BY ALL) SELECT rec_id, bucket, round(rms / max(rms) OVER (PARTITION BY rec_id), 3) AS peak FROM b",
)
def _(spark, sf_dir):
    return op.waveform_peaks(d.samples(spark, sf_dir), 10)


@query("a12_downmix", f"{_SAMPLES} SELECT rec_id // 2 AS rec_id, idx, round(avg(v), 6) AS v FROM samples GROUP BY ALL")
def _(spark, sf_dir):
    channels = d.samples(spark, sf_dir).withColumn("rec_id", F.floor(F.col("rec_id") / 2))
    return op.downmix(channels).select("rec_id", "idx", F.round("v", 6).alias("v"))


@query("a13_percentile_floor", f"{_SAMPLES} SELECT rec_id, round(list_sort(list(v))[CAST(floor((count(*) - 1) * 0.95) AS INT) + 1], 6) AS p95 FROM samples GROUP BY rec_id")
def _(spark, sf_dir):
    return op.percentile_floor(d.samples(spark, sf_dir), ["rec_id"], "v", 0.95).select("rec_id", F.round("v", 6).alias("p95"))


@query("a11_rms_envelope", f"{_SAMPLES}, b AS (SELECT rec_id, b, b * 64 // 100 AS s, least(64, greatest(b * 64 // 100 + 1, (b + 1) * 64 // 100)) AS e FROM (SELECT DISTINCT rec_id FROM samples), range(100) t(b)), r AS (SELECT b.rec_id, b.b AS bucket, sqrt(avg(v * v)) AS rms FROM b JOIN samples x ON x.rec_id = b.rec_id AND x.idx >= s AND x.idx < e GROUP BY ALL) SELECT rec_id, bucket, round(rms / max(rms) OVER (PARTITION BY rec_id), 6) AS rms FROM r")
def _(spark, sf_dir):
    return op.normalise(op.rms_envelope(d.samples(spark, sf_dir), 100)).select("rec_id", "bucket", F.round("rms", 6).alias("rms"))


@query("a12_channels", f"{_SAMPLES} SELECT rec_id // 2 AS rec_id, rec_id % 2 AS channel, idx, round(v, 6) AS v FROM samples UNION ALL SELECT rec_id // 2, -1, idx, round(v, 6) FROM samples WHERE rec_id % 2 = 0")
def _(spark, sf_dir):
    s = d.samples(spark, sf_dir).select(F.floor(F.col("rec_id") / 2).alias("rec_id"), (F.col("rec_id") % 2).alias("channel"), "idx", F.round("v", 6).alias("v"))
    return op.channel(s, None).unionByName(op.channel(s, 0).withColumn("channel", F.lit(-1).cast("long")))


@query("w15_energy_bins", f"{_BINS} SELECT rec_id, bin, round(power * 1e6, 6) AS power, round(1e6 * avg(power) OVER (PARTITION BY rec_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM bins")
def _(spark, sf_dir):
    return op.smoothed(_bins(spark, sf_dir)).select("rec_id", "bin", F.round(F.col("power") * 1e6, 6).alias("power"), F.round(F.col("smooth") * 1e6, 6).alias("smooth"))


@query("w15_blocks", f"{_BLOCKS} SELECT rec_id, block, round(power * 1e6, 6) AS power FROM blocks")
def _(spark, sf_dir):
    return op.blocks(_bins(spark, sf_dir)).select("rec_id", "block", F.round(F.col("power") * 1e6, 6).alias("power"))


@query("w15_quiet_for", f"{_BINS}, m AS (SELECT rec_id, max(bin) AS top, coalesce(max(bin) FILTER (10 * log10(power + 1e-12) >= -57), min(bin) - 1) AS loud FROM bins GROUP BY rec_id) SELECT rec_id, least(top - loud, 30) AS quiet FROM m")
def _(spark, sf_dir):
    return op.quiet_for(_bins(spark, sf_dir), -57.0, 30)


@query(
    "a14_noise_floor",
    f"""{_BLOCKS}, l AS (SELECT *, 10 * log10(power + 1e-12) AS db, avg(power) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY rec_id) AS n FROM blocks),
f AS (SELECT rec_id, greatest(min(10 * log10(m + 1e-12)) FILTER (block >= 2), -75) AS fl, list_sort(list(db) FILTER (block >= n - 200)) AS d FROM l GROUP BY rec_id),
p AS (SELECT rec_id, fl, d[CAST(floor((len(d) - 1) * 0.95) AS INT) + 1] AS p95 FROM f), e AS (SELECT rec_id, count(*) >= 100 AS enough FROM bins GROUP BY rec_id),
k AS (SELECT e.rec_id, p95, CASE WHEN enough AND fl <= -40 THEN fl END AS fl FROM e LEFT JOIN p USING (rec_id))
SELECT rec_id, round(fl, 6) AS floor_db, round(CASE WHEN fl IS NULL THEN NULL WHEN p95 >= fl + 20 THEN least(fl + 12, p95 - 15) ELSE fl + 12 END, 6) AS limit_db FROM k""",
)
def _(spark, sf_dir):
    return op.noise_floor(_bins(spark, sf_dir)).select("rec_id", F.round("floor_db", 6).alias("floor_db"), F.round("limit_db", 6).alias("limit_db"))


@query(
    "a19_separation_quality",
    f"{_PAIRS}, s AS (SELECT rec_id, sum(e * r) AS er, sum(r * r) AS rr, sum(e * e) AS ee, corr(e, r) AS c, sum(e * e) FILTER (idx % 3 = 0) / sum(r * r) FILTER (idx % 3 = 0) AS k, sum(e * e) FILTER (idx % 3 = 1) / sum(r * r) FILTER (idx % 3 = 1) AS q FROM pairs GROUP BY rec_id) SELECT rec_id, round(10 * log10(er * er / rr / (ee - er * er / rr)), 6) AS si_sdr_db, round(c, 6) AS corr, round(10 * log10(k), 6) AS keep_db, round(10 * log10(q), 6) AS suppress_db FROM s",
)
def _(spark, sf_dir):
    own = F.when(F.col("idx") % 3 == 0, True).when(F.col("idx") % 3 == 1, False)
    return op.separation_quality(_pairs(spark, sf_dir).withColumn("own", own)).select("rec_id", *(F.round(c, 6).alias(c) for c in ("si_sdr_db", "corr", "keep_db", "suppress_db")))


@query(
    "a20_decision_drift",
    f"""{_PAIRS}, c AS (SELECT rec_id, r, e, (r > 0) <> (e > 0) AS flip, abs(r) AS a FROM pairs)
SELECT rec_id, round(count(*) FILTER (r > 0 AND e > 0) / count(*) FILTER (r > 0 OR e > 0), 6) AS agreement, count(*) AS frames, count(*) FILTER (flip) AS flips, round(min(a) FILTER (flip), 6) AS least, round(quantile_cont(a, 0.5) FILTER (flip), 6) AS middle, round(max(a) FILTER (flip), 6) AS most,
  {", ".join(f"round(count(*) FILTER (a <= {w / 100}) / count(*), 6) AS within_{w}" for w in (1, 5, 10))} FROM c GROUP BY rec_id""",
)
def _(spark, sf_dir):
    drift = op.decision_drift(_pairs(spark, sf_dir), ["rec_id"], 0.0)
    return drift.withColumns({c: F.round(c, 6) for c in ("least", "middle", "most")})


@query(
    "a15_speaker_centroid",
    """WITH p AS (SELECT label, vec_id, embedding, 300 + 100 * (vec_id % 50) AS dur FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dur DESC, vec_id) AS k FROM p),
x AS (SELECT label, dur, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM r WHERE k <= 24), s AS (SELECT label, dim, sum(v * dur) AS x FROM x GROUP BY ALL)
SELECT label, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM s""",
)
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pieces = e.select("label", F.col("vec_id").alias("piece"), "embedding", (300 + 100 * (F.col("vec_id") % 50)).alias("dur_ms"))
    return op.speaker_centroid(pieces, "label").select("label", "dim", F.round("x", 6).alias("x"))


@query("f12_power_db", f"{_SAMPLES} SELECT rec_id, round(10 * log10(avg(v * v) + 1e-12), 6) AS db FROM samples GROUP BY rec_id")
def _(spark, sf_dir):
    return d.samples(spark, sf_dir).groupBy("rec_id").agg(F.avg(F.col("v") * F.col("v")).alias("p")).select("rec_id", F.round(f.power_db(F.col("p")), 6).alias("db"))


@query("f13_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms FROM embeddings")
def _(spark, sf_dir):
    whole = F.aggregate(f.l2_normalise(F.col("embedding")), F.lit(0.0), lambda s, v: s + F.abs(v))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(whole, 6).alias("length"), F.round(f.rms(F.col("embedding")), 6).alias("rms"))


@query(
    "f13_cosine",
    "SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(f.cosine(F.col("a"), F.col("b")), 6).alias("c"))
