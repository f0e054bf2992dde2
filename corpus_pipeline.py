"""A corpus pipeline of numbered operators; each stage works on what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewords.llm import bpe, mixing, quality, secrets, simhash
from tidewords.sources.shared import shared_folder

STAGES = [
    ("quality classifier", quality.stage),
    ("SimHash near-dedup", simhash.stage),
    ("secret scans", secrets.stage),
    ("mixing sources", mixing.stage),
    ("byte-level BPE", bpe.stage),
]
#: No SQL expresses the trained classifier; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each one's rows are written to the shared folder and read again."""
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{n}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{n}")
    return docs
