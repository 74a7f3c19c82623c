"""Helpers shared by the training-data operators.

Everything intermediate is written below the cluster's shared ``spark.checkpoint.dir`` (see
``tessera.session``): a written table cuts the lineage and survives the loss of any executor.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

#: Rows of a key table up to which it may be broadcast (a key row is below 64 bytes, so 16 MB).
BROADCAST_ROWS = 250_000

#: Runs of these separate the words of the whitespace-based operators.
SPACES = "[\\x20\\x09-\\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared scratch folder and read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "__dict__", {}).pop("scratch", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already written) with a broadcast hint if it has at most ``limit`` rows.

    Without the hint the join shuffles both sides by key; results are the same.
    """
    return F.broadcast(df) if df.count() <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character as it is (``lower`` alone also changes accented letters)."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``written``, and then the shuffle files behind it may go.

    Spark deletes the files of a shuffle when the driver's JVM collects the plan that made them, and the last plan
    stays reachable until another job has run. An operator of several large steps would else hold the files of all of
    them until its end.
    """
    out = written(df, name)
    df.sparkSession.range(1).count()
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
