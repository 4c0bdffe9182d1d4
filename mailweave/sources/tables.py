"""Parquet tables of a data directory."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory, columns pruned by whoever reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, where all executors can write.

    A folder of our own takes its place only where the session has none and runs on this machine alone, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", max_rows: int = 1_000_000) -> DataFrame:
    """Join with a broadcast of ``small`` where it proves to have at most ``max_rows`` rows, by shuffles beyond that.

    For narrow rows of numbers: a million take some tens of megabytes.
    """
    held = checkpointed(small)
    return big.join(F.broadcast(held) if held.count() <= max_rows else held, on, how)
