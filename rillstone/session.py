"""A session with the settings the operators rely on."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "rillstone", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI casts (bad ones fail unless written as try_cast), adaptive execution with skew joins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {})
    return b.config(map=settings | conf).getOrCreate()


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="rillstone-")


def scratch(spark: SparkSession) -> str:
    """A new folder's name in spark.checkpoint.dir, the folder that driver and executors share; under a local master a
    temporary one will do where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or _own_dir()).rstrip('/')}/rillstone-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str, name: str) -> DataFrame:
    """df written as a table in the folder `at` and read back: it is computed once, and lineage ends there."""
    df.write.mode("overwrite").parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")
