"""Helpers shared by the text operators: tables, checkpoints and hashing."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship


__all__ = ["checkpoint_dir", "cut", "keep", "ship", "table", "tokenizer_dir", "unit_hash"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's setting where there is one, else a local folder for tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="strandex-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Keeps df for a second use; lost parts are computed again from their lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def unit_hash(*cols: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the values and the seed only."""
    h = F.xxhash64(*cols, F.lit(seed))
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def tokenizer_dir() -> str:
    """Folder of the public vocabularies; STRANDEX_TOKENIZERS overrides it."""
    return os.environ.get("STRANDEX_TOKENIZERS", "/opt/tokenizers")
