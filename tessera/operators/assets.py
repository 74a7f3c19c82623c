"""Resolving metadata rows to their asset files (PR-3, PR-9, JN-1..4).

The reference probes the file system once per row (exists? else try the fallback name). Here the
folder is a manifest DataFrame ``(name, path)`` and each probe is an equi-join on ``name``: Spark
picks broadcast or sort-merge from statistics (AQE), never a per-row lookup. Only ``name`` and
``path`` take part in the joins; image bytes are joined once, at the end, by the sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_id, padded_id


def asset_candidates(df: DataFrame, id_col: str = "national_number", ext: str = ".png") -> DataFrame:
    """Add ``base_id``, ``padded_id``, ``candidate1``, ``candidate2`` (priority order).

    candidate1 = ``<id><ext>`` when the id carries a ``_`` suffix, else ``<padded><ext>``;
    candidate2 = ``<base><ext>``. Ids whose base is not an integer get no candidate (the
    reference fails on them); they surface as missing rows.
    """
    nid = F.col(id_col).cast("string")
    base = base_id(nid)
    padded = padded_id(base, strict=True)
    ok = padded.isNotNull()
    cand1 = F.when(ok, F.when(nid.contains("_"), F.concat(nid, F.lit(ext))).otherwise(F.concat(padded, F.lit(ext))))
    cand2 = F.when(ok, F.concat(base, F.lit(ext)))
    return df.select("*", base.alias("base_id"), padded.alias("padded_id"),
                     cand1.alias("candidate1"), cand2.alias("candidate2"))


def unique_names(manifest: DataFrame) -> DataFrame:
    """The manifest with one row per name (a folder lists a name once; the smallest path wins)."""
    return manifest.groupBy("name").agg(F.min("path").alias("path"))


def resolve_assets(df: DataFrame, manifest: DataFrame, id_col: str = "national_number") -> DataFrame:
    """JN-1: left lookup on candidate1, else candidate2.

    Adds ``asset_name``, ``asset_path`` and ``match_rank`` (1, 2, or null when neither exists).
    A name that ``manifest`` lists more than once counts once, with its smallest path. Rows
    without a candidate join on a key of their own, so null keys do not meet in one task.
    """
    m = asset_candidates(df, id_col).withColumn("_a_key", F.concat(F.lit("no candidate "), F.xxhash64(id_col).cast("string")))
    files = unique_names(manifest)
    a1 = files.select(F.col("name").alias("_a1_name"), F.col("path").alias("_a1_path"))
    a2 = files.select(F.col("name").alias("_a2_name"), F.col("path").alias("_a2_path"))
    j = (m.join(a1, F.coalesce("candidate1", "_a_key") == F.col("_a1_name"), "left")
          .join(a2, F.coalesce("candidate2", "_a_key") == F.col("_a2_name"), "left").drop("_a_key"))
    rank = F.when(F.col("_a1_name").isNotNull(), F.lit(1)).when(F.col("_a2_name").isNotNull(), F.lit(2))
    return (j.withColumn("asset_name", F.coalesce("_a1_name", "_a2_name"))
             .withColumn("asset_path", F.coalesce("_a1_path", "_a2_path"))
             .withColumn("match_rank", rank)
             .drop("_a1_name", "_a1_path", "_a2_name", "_a2_path", "candidate1", "candidate2"))


def resolved_rows(resolved: DataFrame) -> DataFrame:
    """JN-2 / PR-9: rows that found an asset (the ones that are kept)."""
    return resolved.where(F.col("match_rank").isNotNull())


def missing_assets(resolved: DataFrame) -> DataFrame:
    """JN-3: rows without an asset (the reference prints a warning and skips them)."""
    return resolved.where(F.col("match_rank").isNull())


def strict_asset_name(id_col: str = "national_number", ext: str = ".png"):
    """The loader's file name: ``zfill(3)`` of the base id, no fallback."""
    return F.concat(padded_id(base_id(F.col(id_col).cast("string")), strict=False), F.lit(ext))


def strict_missing(df: DataFrame, manifest: DataFrame, id_col: str = "national_number") -> DataFrame:
    """JN-4: rows whose strict loader name is absent from the manifest (the loader would fail)."""
    keyed = df.withColumn("strict_name", strict_asset_name(id_col))
    return keyed.join(manifest.select(F.col("name").alias("strict_name")), "strict_name", "left_anti")


def strict_lookup(df: DataFrame, manifest: DataFrame, id_col: str = "national_number",
                  fail: bool = True, unique: bool = False) -> DataFrame:
    """Lookup on the strict name; a missing file fails the job in-plan.

    ``fail=False`` keeps violators, with a null ``image_path``, beside the other rows. ``unique``: the manifest
    is known to list a name once.
    """
    keyed = df.withColumn("strict_name", strict_asset_name(id_col))
    listed = manifest if unique else unique_names(manifest)
    names = listed.select(F.col("name").alias("strict_name"), F.col("path").alias("image_path"))
    out = keyed.join(names, "strict_name", "left")
    if fail:
        out = out.withColumn("image_path", F.when(
            F.col("image_path").isNull(),
            F.raise_error(F.concat(F.lit("Missing asset for #"), F.col(id_col).cast("string"))),
        ).otherwise(F.col("image_path")))
    return out
