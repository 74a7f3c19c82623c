"""Session construction and shared scratch locations.

Library functions never create a session themselves; they take one. This module is for
entry points (bench, tests, examples) and for the few operators that round-trip data through
storage (sinks, image export). Scratch data always lives under the cluster's shared
``spark.checkpoint.dir`` so that executors on other hosts can read it back.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (ids and short names, some 16 MB) up to which it is broadcast.
SMALL_ROWS = 250_000


def get_spark(master: str = "local[*]", app: str = "tessera", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Image rows are wide (one 3x215x215 tensor is ~555 KB): keep Arrow batches small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder named by the cluster, or None when unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        # getCheckpointDir() returns <root>/<app uuid>; scratch goes next to it.
        return current.rstrip("/").rsplit("/", 1)[0]
    return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder; create a local one only for a local master (tests)."""
    root = checkpoint_root(spark)
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder path under the shared checkpoint root (not created here)."""
    root = ensure_checkpoint_dir(spark)
    return f"{root}/tessera-scratch/{name}-{uuid.uuid4().hex[:12]}"



def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared scratch folder and read again: computed once, whatever reads them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, so that wide rows need not move to meet a narrow table.

    It is counted for that; beyond the limit the join shuffles both sides, with the same result.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
