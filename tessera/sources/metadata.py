"""Delimited metadata scan and per-split sinks (SC-1..3, SC-6, SC-7, SC-9)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_id, null_tokens

#: Rows of one CSV file at most: a file of quoted line breaks is read by one task.
CSV_FILE_ROWS = 200_000

_CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    # Writers trim blanks by default; the reader here must see text exactly as written.
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_metadata(spark: SparkSession, path: str, sep: str = ";", schema=None, multi_line: bool = True) -> DataFrame:
    """SC-1: header row, ``sep``-separated; every column is text unless ``schema`` says otherwise.

    ``multi_line``: fields hold line breaks inside quotes; Spark then cannot split a file, so write
    many of them (the sinks here do). Without such fields pass False, and files are split.

    Ids are read as text on purpose: leading zeros survive. :func:`canonicalize_ids` reproduces
    a type-inferring reader where that matters.
    """
    reader = spark.read.options(**_CSV_OPTIONS).option("sep", sep).option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def canonicalize_ids(df: DataFrame, col: str = "national_number", out_col: str | None = None) -> DataFrame:
    """SC-2: if *every* value of ``col`` is an integer, drop leading zeros (``007`` -> ``7``).

    The whole-column test is one aggregate evaluated once as a scalar subquery; rows are not
    moved.
    """
    flag = df.agg(F.bool_and(F.coalesce(F.col(col).rlike(r"^-?\d+$"), F.lit(True))).alias("all_int")).scalar()
    return df.withColumn(out_col or col, canonical_id(col, F.coalesce(flag, F.lit(False))))


def apply_null_tokens(df: DataFrame, cols: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """SC-3: treat ``tokens`` as missing in ``cols`` (Spark nulls only the empty string)."""
    return df.select(*[null_tokens(c, tokens).alias(c) if c in cols else F.col(c) for c in df.columns])


def write_splits(df: DataFrame, out_dir: str, fmt: str = "csv", sep: str = ";",
                 split_col: str = "split", mode: str = "overwrite") -> None:
    """SC-6: one folder per split (``split=train/...``); readers prune by ``split``."""
    w = df.write.mode(mode).partitionBy(split_col)
    if fmt == "csv":
        w.options(**_CSV_OPTIONS).option("sep", sep).option("maxRecordsPerFile", CSV_FILE_ROWS).csv(out_dir)
    else:
        w.format(fmt).save(out_dir)


def read_splits(spark: SparkSession, out_dir: str, fmt: str = "csv", sep: str = ";",
                splits: Sequence[str] | None = None) -> DataFrame:
    """Read back what :func:`write_splits` wrote; ``splits`` becomes a partition filter."""
    if fmt == "csv":
        df = read_metadata(spark, out_dir, sep=sep)
    else:
        df = spark.read.format(fmt).load(out_dir)
    if splits is not None:
        df = df.where(F.col("split").isin(list(splits)))
    return df


def split_assets(resolved: DataFrame, split_col: str = "split") -> DataFrame:
    """SC-7: the per-split asset folder as rows ``(split, name, path)``.

    The reference copies one file per kept row; copying the same name twice leaves one file, so
    the folder is the distinct ``(split, name)`` set. Which path wins a name clash is fixed:
    the smallest one. SC-8: rows of a fan-out (with ``aug_no``) have a file of their own,
    ``<id>.png`` of the augmented id, whose ``path`` is the original that is turned by ``angle``.
    """
    kept = resolved.where(F.col("asset_name").isNotNull())
    name, angle = F.col("asset_name"), F.lit(0.0)
    if "aug_no" in resolved.columns:
        turned = F.col("aug_no") > 0
        name = F.when(turned, F.concat(F.col("national_number"), F.lit(".png"))).otherwise(name)
        angle = F.when(turned, F.col("angle")).otherwise(angle)
    rows = kept.select(split_col, name.alias("name"), F.struct(F.col("asset_path").alias("path"), angle.alias("angle")).alias("file"))
    return rows.groupBy(split_col, "name").agg(F.min("file").alias("file")).select(split_col, "name", "file.path", "file.angle")


def asset_contents(assets: DataFrame, files: DataFrame, turn: Callable[[Column, Column], Column] | None = None,
                   split_col: str = "split") -> DataFrame:
    """``(split, name, path, angle, content, digest)`` of every asset; nothing is left out.

    ``files`` is a ``binaryFile`` scan ``(path, content)``, a path once. An asset whose file is not there fails the job in the plan. A copy
    with an angle holds ``turn(content, angle)``, never its original's bytes: without ``turn``, and where it gives
    null, the job fails. ``digest`` is the SHA-256 of the content.
    """
    bodies = files.select(F.col("path").alias("_path"), F.col("content").alias("_body"))
    joined = assets.join(bodies, F.col("path") == F.col("_path"), "left")

    def refuse(reason: str) -> Column:
        return F.raise_error(F.concat(F.lit(reason), F.col("name"), F.lit(" from "), F.coalesce("path", F.lit("no file")))).cast("binary")

    turned = turn(F.col("_body"), F.col("angle")) if turn else F.lit(None).cast("binary")
    content = (F.when(F.col("_body").isNull(), refuse("No contents for "))
               .when(F.coalesce("angle", F.lit(0.0)) == 0.0, F.col("_body"))
               .otherwise(F.coalesce(turned, refuse("No turned contents for "))))
    out = joined.select(split_col, "name", "path", "angle", content.alias("content"))
    return out.withColumn("digest", F.sha2("content", 256))


def write_split_assets(assets: DataFrame, files: DataFrame, out_dir: str,
                       split_col: str = "split", turn: Callable[[Column, Column], Column] | None = None) -> None:
    """SC-7/SC-8 sink: :func:`asset_contents` as parquet, partitioned by split.

    Content is joined here, once, after all lookups ran on names only.
    """
    asset_contents(assets, files, turn, split_col).write.mode("overwrite").partitionBy(split_col).parquet(out_dir)


def write_results(df: DataFrame, path: str) -> None:
    """SC-9: the grid-search result table as comma CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)
