"""Deterministic derivations of the toolkit's inputs from the driver tables.

The driver tables hold no sprite folders, loss logs or checkpoint folders, so each input the
toolkit expects is derived from them with plain DataFrame expressions (see FIXTURES.md §2):

* ``metadata``   (M)    documents left join labels
* ``manifest``   (A)    sprite names from labels
* ``loss_log``   (LOG)  per-item losses from events, batched and grouped in epochs
* ``val_curve``  (LOGR) one validation loss per epoch from events
* ``checkpoints``(CK)   checkpoint file names from LOG epochs
* ``vectors``    (VEC)  token-vector rows from embeddings
* ``pairs``      (PAIR) prediction/truth pairs from embeddings
* ``rasters``    (IMG)  4x4 RGBA byte rasters from embeddings

Every derivation reads the tables, so work grows with the scale factor. Only the columns a
query selects are read (Catalyst prunes the parquet scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import padded_id
from .session import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M: the five metadata columns (plus ``doc_id``) the preparation step reads."""
    secondary = F.when(F.col("toxic") == 1, F.lit("TOXIC")).when(F.col("quality") == 0, F.lit("low quality"))
    labels = table(spark, sf_dir, "labels").select("doc_id", secondary.alias("secondary_type"))
    return unlabelled(spark, sf_dir).join(small(labels), "doc_id", "left").select(
        "doc_id", "national_number", "description", "primary_type", "secondary_type", "classification")


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M without ``secondary_type``, the one column that needs the labels: no join."""
    doc_id = F.col("doc_id")
    suffix = F.when(doc_id % 7 == 0, F.lit("_1")).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select(
        doc_id,
        F.concat(doc_id.cast("string"), suffix).alias("national_number"),
        F.col("text").alias("description"),
        F.col("lang").alias("primary_type"),
        F.col("source").alias("classification"),
    )


def manifest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A as ``(doc_id, name)``: which sprite file exists for a labelled document."""
    labels = table(spark, sf_dir, "labels")
    doc_id = F.col("doc_id")
    id_s = doc_id.cast("string")
    name = (
        F.when(doc_id % 14 == 0, F.concat(id_s, F.lit("_1.png")))
        .when(doc_id % 3 == 0, F.concat(id_s, F.lit(".png")))
        .otherwise(F.concat(padded_id(id_s, strict=False), F.lit(".png")))
    )
    return labels.select(doc_id, name.alias("name"))


def manifest(spark: SparkSession, sf_dir: str, root: str = "sprites") -> DataFrame:
    """A: a sprite-folder manifest ``(name, path)``; names are unique."""
    return manifest_names(spark, sf_dir).select(
        "name", F.concat_ws("/", F.lit(root), F.col("name")).alias("path"))


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG: ``(config, epoch, split, batch_id, item_loss)`` per scored item."""
    ev = table(spark, sf_dir, "events")
    epoch = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return ev.select(
        F.col("event_type").alias("config"),
        epoch.cast("int").alias("epoch"),
        F.when(F.col("event_id") % 4 == 0, F.lit("val")).otherwise(F.lit("train")).alias("split"),
        (F.col("user_id") % 8).alias("batch_id"),
        F.col("value").alias("item_loss"),
    )


def val_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOGR: ``(config, epoch, val_loss)``; epoch = order of ``(ts, event_id)`` within config.

    The epoch number is an exact per-config rank computed without a per-config window, so a
    config holding most of the rows is still spread over many tasks.
    """
    from .operators.ranking import exact_rank

    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("config"), "ts", "event_id", F.col("value").alias("val_loss"))
    ranked = exact_rank(ev, [F.col("ts"), F.col("event_id")], F.date_trunc("minute", "ts"), partition_by=["config"],
                        rank_col="epoch", tiebreak=False)
    return ranked.select("config", F.col("epoch").cast("int").alias("epoch"), "val_loss")


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CK: ``(config, name)`` file names of each config's checkpoint folder."""
    epochs = loss_log(spark, sf_dir).select("config", "epoch").distinct()
    per_epoch = epochs.select("config", F.format_string("model_epoch_%d.pt", "epoch").alias("name"))
    configs = epochs.select("config").distinct()
    best = configs.select("config", F.lit("best_model_epoch_40.pt").alias("name"))
    backup = configs.where(F.col("config") == "click").select(
        "config", F.lit("model_epoch_31.pt.bak").alias("name"))
    return per_epoch.unionByName(best).unionByName(backup)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC: ``(seq_id, vec_id, mask, vec array<double>)``; 64 dims per row."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("label").alias("seq_id"),
        "vec_id",
        F.when(F.col("vec_id") % 5 != 0, F.lit(1)).otherwise(F.lit(0)).alias("mask"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAIR: prediction ``a`` and truth ``b`` with ``b.vec_id = a.vec_id + 1``."""
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    a = emb.select(F.col("vec_id").alias("id_pred"), F.col("label").alias("label"),
                   F.col("vec").alias("pred"))
    b = emb.select(F.col("vec_id").alias("id_truth"), F.col("vec").alias("truth"))
    return a.join(b, F.col("id_truth") == F.col("id_pred") + 1, "inner")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG: ``(vec_id, height, width, rgba array<int>)``, a 4x4 RGBA raster per embedding.

    Byte = floor(clamp((v + 1) / 2, 0, 1) * 255), stored row-major, channels last.
    """
    emb = table(spark, sf_dir, "embeddings")
    to_byte = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v.cast("double") + 1.0) / 2.0)) * 255.0).cast("int")
    return emb.select("vec_id", F.lit(4).alias("height"), F.lit(4).alias("width"),
                      F.transform("embedding", to_byte).alias("rgba"))
