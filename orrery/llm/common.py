"""Plumbing of the text operators: shared scratch tables and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH_ROWS = 512
_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only in local mode, where none need be named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="scratch-"))
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of few rows, as rows hold whole texts."""
    spark = df.sparkSession
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions as the session sets them (they follow the input's size)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def apart(df: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with every column but ``own`` under a name that no operator uses, and what brings the names back."""
    inner = [c if c in own else f"_extra{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*inner), [F.col(i).alias(c) for i, c in zip(inner, df.columns, strict=True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
