"""Asset folder, image and checkpoint-folder scans (SC-4, SC-5, SC-10).

Folders are read with Spark's own file sources (whose file index is on the driver). Lookups
select only ``name``/``path``/``length`` so the ``binaryFile`` source never reads file bodies
for them (content is pruned from the scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name(path_col: str = "path"):
    return F.element_at(F.split(F.col(path_col), "/"), -1)


def scan_assets(spark: SparkSession, folder: str, glob: str = "*.png", with_content: bool = False) -> DataFrame:
    """SC-4: manifest ``(name, path, length[, content])`` of a folder."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    cols = [file_name().alias("name"), F.col("path"), F.col("length")]
    if with_content:
        cols.append(F.col("content"))
    return df.select(*cols)


def scan_images(spark: SparkSession, folder: str, invalid: str = "fail") -> DataFrame:
    """SC-5: decoded images (Spark ``image`` source: BGR(A) bytes, see ``images.from_spark_image``).

    An undecodable file fails the job; ``invalid="keep"`` returns it with a null ``height``, so
    that callers can list it (:func:`undecodable_images`). Files are never left out.
    """
    if invalid not in ("fail", "keep"):
        raise ValueError(f"invalid: {invalid!r}")
    df = spark.read.format("image").option("dropInvalid", False).load(folder)
    bad = _undecodable()
    if invalid == "keep":
        return df.select(F.when(~bad, F.col("image")).otherwise(F.struct(
            F.col("image.origin"), *[F.lit(None).cast(df.schema["image"].dataType[c].dataType).alias(c)
                                     for c in ("height", "width", "nChannels", "mode", "data")])).alias("image"))
    return df.select(F.when(bad, F.raise_error(F.concat(F.lit("Undecodable image "), F.col("image.origin"))).cast(df.schema["image"].dataType))
                     .otherwise(F.col("image")).alias("image"))


def _undecodable():
    """The ``image`` source marks a file that it cannot decode by a height of -1."""
    return F.col("image.height") < 0


def undecodable_images(spark: SparkSession, folder: str) -> DataFrame:
    """The violators: ``(name, path)`` of files that no decoder reads."""
    df = spark.read.format("image").option("dropInvalid", False).load(folder)
    return df.where(_undecodable()).select(file_name("image.origin").alias("name"), F.col("image.origin").alias("path"))


def scan_checkpoints(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """SC-10: checkpoint folder listing ``(name, path)``; file bodies are never read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return df.select(file_name().alias("name"), "path")


def scan_checkpoint_folders(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """SC-10 for many folders: ``(folder, name)`` of every checkpoint below ``root``, file bodies unread.

    A checkpoint is what lies one level below a folder of ``root``: a file, or itself a folder of part files (listed once). A folder
    written by partition columns (``config=a/name=b``) counts as its values. Files deeper down, and at any depth, are discovered
    recursively; files right below ``root`` belong to no folder and are left out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.split(F.substring_index(F.col("path"), base + "/", -1), "/")
    value = lambda c: F.url_decode(F.regexp_replace(F.regexp_replace(c, "^[A-Za-z0-9_]+=", ""), r"\+", "%2B"))
    found = reader.load(root).select(below.alias("_below")).where(F.size("_below") >= 2)
    return found.select(value(F.get("_below", F.lit(0))).alias("folder"), value(F.get("_below", F.lit(1))).alias("name")).distinct()
