"""Results that are computed once and kept where all executors find them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the folder for checkpoints that the session names; a fresh one only where none is set and all runs on one machine, as in tests."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
