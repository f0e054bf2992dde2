"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Unset, a temporary folder serves a single machine; a cluster must name one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder(spark.sparkContext.applicationId)


@lru_cache(8)
def _own_folder(_application: str) -> str:
    """One folder a session of a single machine."""
    return tempfile.mkdtemp(prefix="spark-shared-")


def written(df: DataFrame) -> DataFrame:
    """A table worked out once and kept in the shared folder as Parquet: a fraction of what ``settle`` takes there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """A table that several parts of a plan read, worked out once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
