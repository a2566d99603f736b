"""Helpers that several operators use."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where none is set, a temporary one in local mode, as in tests, and an error on a cluster."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set, and a cluster has no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))
        folder = context._jsc.sc().getCheckpointDir()
    return folder.get()


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_shuffles(spark: SparkSession) -> None:
    """Have shuffle files removed as soon as the query that wrote them ends; what is used again is saved."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def jit_sized_methods(spark: SparkSession) -> None:
    """Have stages whose generated method the JVM would not compile (over 8000 bytes) split into small methods."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def small_batches(spark: SparkSession) -> None:
    """Have rows go to Python in batches of a thousand rows, as a batch stands in the memory of both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
