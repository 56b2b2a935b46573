"""Session and lineage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lectern", cores: int | str = "*") -> SparkSession:
    """A local session in UTC with adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one where it is unset on a single machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage; `by` is a column to partition by."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write if by is None else df.repartition(by).write.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
