"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows of one Arrow batch handed to Python. Texts differ a thousandfold in length, so the usual 10,000 rows are too many.
ARROW_ROWS = 1000


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; a fresh one only where none is set and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, where a lost executor cannot take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_unsized(df: DataFrame) -> DataFrame:
    """df as by cut(), without the plan's estimate of its size.

    A checkpoint takes the estimate along, and that of a join is the product of its sides: a loop that joins what it has cut gets a number
    with three times as many digits each round, which after some fifteen rounds is more than the driver can hold.
    """
    spark, done = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def placed(df: DataFrame, by: str) -> DataFrame:
    """df as by cut(), dealt by the hash of one column, so that later joins and groups on it don't move it again.

    A plan that adapts at run time forgets how its rows lie; so this one action is planned ahead.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return cut(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by))
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """Keeps a batch of long texts well inside a Python worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def ascii_lower(text) -> F.Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish
