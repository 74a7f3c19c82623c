"""Image and file-folder queries (IMG binding, SC-4/5, IM-2..5, ML-3). Rows-only checks:
the pixel work has no SQL form; tests compare against numpy on hand-made fixtures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import bindings as B
from ..functions.arrays import let
from ..operators import images as IM
from ..operators import split as SP
from ..session import scratch_path
from ..sources import assets as SA
from . import sql_fragments as Q
from .catalog import query, with_
from .catalog_text import with_recursive


def _export(spark, sf_dir):
    """Write the IMG rasters as PNG files (one per embedding) to a fresh shared folder."""
    folder = scratch_path(spark, "sprites")
    IM.export_pngs(B.rasters(spark, sf_dir), folder)
    return folder


@query("asset_manifest", """
SELECT printf('%03d.png', vec_id) AS name FROM embeddings""")
def asset_manifest(spark, sf_dir):
    """SC-4: the sprite folder listed by the ``binaryFile`` source (content pruned)."""
    folder = _export(spark, sf_dir)
    return SA.scan_assets(spark, folder).select("name")


@query("image_scan", """
SELECT printf('%03d.png', vec_id) AS name, 4 AS height, 4 AS width, 4 AS n_channels FROM embeddings""")
def image_scan(spark, sf_dir):
    """SC-5: the sprite folder decoded by the ``image`` source."""
    folder = _export(spark, sf_dir)
    img = SA.scan_images(spark, folder)
    return img.select(SA.file_name("image.origin").alias("name"), F.col("image.height").alias("height"),
                      F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"))


@query("quarter_turns", with_(Q.IMG_LONG, """ip AS (SELECT vec_id, pos // 4 AS pixel, pos % 4 AS ch, b FROM il)""",
                              """al AS (SELECT vec_id, pixel, b AS a FROM ip WHERE ch = 3)""",
                              """tt AS (SELECT ip.vec_id, ip.pixel // 4 AS y, ip.pixel % 4 AS x, ip.ch, 255 * (255 - al.a) + ip.b * al.a + 128 AS t
                                        FROM ip JOIN al ON ip.vec_id = al.vec_id AND ip.pixel = al.pixel WHERE ip.ch < 3)""",
                              """rgb AS (SELECT vec_id, y, x, ch, ((t >> 8) + t) >> 8 AS v FROM tt)""",
                              """turned AS (
  SELECT vec_id, 1 AS turns, 3 - x AS y, y AS x, ch, v FROM rgb
  UNION ALL SELECT vec_id, 2, 3 - y, 3 - x, ch, v FROM rgb
  UNION ALL SELECT vec_id, 3, x, 3 - y, ch, v FROM rgb)""") + """
SELECT vec_id, turns, CAST(sum(v * ((y * 4 + x) * 3 + ch + 1)) AS BIGINT) AS checksum FROM turned GROUP BY vec_id, turns""")
def quarter_turns(spark, sf_dir):
    """IM-2 + IM-1 as columns: each raster over white, turned by 90, 180 and 270 degrees."""
    one = B.rasters(spark, sf_dir).withColumn("r0", IM.composite_white_expr("rgba", 4))
    for k in (1, 2, 3):
        one = one.withColumn(f"r{k}", IM.quarter_turn_expr(f"r{k - 1}", "height", "width"))
    each = one.select("vec_id", F.explode(F.array(*[F.struct(F.lit(k).alias("turns"), F.col(f"r{k}").alias("rgb")) for k in (1, 2, 3)])).alias("t"))
    return each.select("vec_id", "t.turns", F.col("t.rgb").alias("rgb")).select("vec_id", "turns", IM.checksum("rgb").alias("checksum"))


@query("rotate_images")
def rotate_images(spark, sf_dir):
    """IM-2 + IM-1: each raster turned by 90 and 120 degrees (canvas grows), over white."""
    r = IM.rotate_rasters(B.rasters(spark, sf_dir), [90.0, 120.0])
    return r.select("vec_id", "angle", "h", "w", IM.checksum("rgb").alias("checksum"))


@query("resize_images")
def resize_images(spark, sf_dir):
    """IM-3: Lanczos resize 4x4 -> 6x6."""
    r = IM.resize_rasters(B.rasters(spark, sf_dir), 6, 6)
    return r.select("vec_id", "h", "w", IM.checksum("rgb").alias("checksum"))


@query("image_tensor")
def image_tensor(spark, sf_dir):
    """IM-4 / FN-11: PNG files -> ``image`` source -> composite, 215x215 Lanczos, [-1, 1], CHW."""
    folder = _export(spark, sf_dir)
    t = IM.image_tensors(SA.scan_images(spark, folder))
    return t.select(SA.file_name("id").alias("name"), "c", "h", "w", F.round("checksum", 3).alias("checksum"))


@query("augmented_assets")
def augmented_assets(spark, sf_dir):
    """IM-5 / SC-8: k=2 rotated copies (120 and 240 degrees) of each raster, over white."""
    a = IM.augmented_images(B.rasters(spark, sf_dir), 2)
    return a.select("vec_id", "aug_no", "h", "w", IM.checksum("rgb").alias("checksum"))


_CHW = with_(Q.IMG_LONG, """ip AS (SELECT vec_id, pos // 4 AS pixel, pos % 4 AS ch, b FROM il)""",
             """al AS (SELECT vec_id, pixel, b AS a FROM ip WHERE ch = 3)""",
             """tt AS (SELECT ip.vec_id, ip.pixel, ip.ch, 255 * (255 - al.a) + ip.b * al.a + 128 AS t FROM ip JOIN al ON ip.vec_id = al.vec_id AND ip.pixel = al.pixel WHERE ip.ch < 3)""",
             """rgb AS (SELECT vec_id, pixel, ch, ((t >> 8) + t) >> 8 AS v FROM tt)""")


@query("channel_planar", _CHW + """
SELECT vec_id, CAST(sum(v * (ch * 16 + pixel + 1)) AS BIGINT) AS checksum, count(*) = 48 AS shaped, count(*) = 3 * 215 * 215 AS full_size FROM rgb GROUP BY vec_id""")
def channel_planar(spark, sf_dir):
    """FN-11 as columns: every raster over white, one plane per channel, with its shape check (3 x 4 x 4, and the loader's size)."""
    r = B.rasters(spark, sf_dir).withColumn("rgb", IM.composite_white_expr("rgba", 4))
    planes = IM.require_shape(IM.channel_planar_expr("rgb", "height", "width", 3), 3, "height", "width", (3, 4, 4))
    report = let(planes, lambda p: F.struct(IM.checksum(p).alias("checksum"), IM.has_shape(p, 3, "height", "width", (3, 4, 4)).alias("shaped"),
                                            IM.has_shape(p, 3, "height", "width").alias("full_size")))
    return r.select("vec_id", report.alias("r")).select("vec_id", "r.checksum", "r.shaped", "r.full_size")


_SEARCH = with_recursive(
    Q.VEC_LONG, "m AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS national_number, label % 2 AS y FROM embeddings)", Q.split_cte(),
    "fx AS (SELECT vl.vec_id, vl.dim + 1 AS i, vl.x FROM vl UNION ALL SELECT vec_id, 65, 1.0 FROM m UNION ALL SELECT vec_id, 66, CAST(y AS DOUBLE) FROM m)",
    "pr AS (SELECT s.split, a.i, b.i AS j, sum(a.x * b.x) AS s FROM fx a JOIN fx b USING (vec_id) JOIN s USING (vec_id) GROUP BY s.split, a.i, b.i)",
    "n AS (SELECT split, s AS n FROM pr WHERE i = 65 AND j = 65)",
    "rw AS (SELECT split, i, list(s / n ORDER BY j) FILTER (j < 66) AS g, max(CASE WHEN j = 66 THEN s / n END) AS c FROM pr JOIN n USING (split) GROUP BY split, i)",
    "gm AS (SELECT split, list(g ORDER BY i) FILTER (i < 66) AS g, list(c ORDER BY i) FILTER (i < 66) AS c, max(CASE WHEN i = 66 THEN c END) AS yy FROM rw GROUP BY split)",
    """cf AS (SELECT row_number() OVER (ORDER BY a.i, b.i) AS config_no, 'ft_lr_' || a.n || '_wd_' || b.n AS config_name, a.v AS lr, b.v AS wd
      FROM (VALUES (1, '0.5', CAST(0.5 AS DOUBLE)), (2, '0.1', CAST(0.1 AS DOUBLE))) a(i, n, v), (VALUES (1, '0.0', CAST(0.0 AS DOUBLE)), (2, '0.01', CAST(0.01 AS DOUBLE))) b(i, n, v))""",
    """st AS (SELECT config_no, 0 AS epoch, list_transform(range(65), lambda x: CAST(0.0 AS DOUBLE)) AS w FROM cf
      UNION ALL
      SELECT st.config_no, st.epoch + 1, list_transform(range(1, 66), lambda i: st.w[i] - cf.lr * (2 * (list_dot_product(gm.g[i], st.w) - gm.c[i]) + cf.wd * st.w[i]))
      FROM st JOIN cf USING (config_no), gm WHERE gm.split = 'train' AND st.epoch < 20)""",
    """ls AS (SELECT config_no, epoch, split, gm.yy - 2 * list_dot_product(st.w, gm.c) + list_dot_product(st.w, list_transform(range(1, 66), lambda i: list_dot_product(gm.g[i], st.w))) AS loss
      FROM st, gm WHERE epoch > 0 AND split <> 'train')""",
    "be AS (SELECT config_no, arg_min(epoch, (loss, epoch)) AS best_epoch, min(loss) AS best_val_loss FROM ls WHERE split = 'val' GROUP BY config_no)")


@query("grid_search", _SEARCH + """
SELECT cf.config_no, cf.config_name, cf.lr AS learning_rate, cf.wd AS weight_decay, best_epoch, round(best_val_loss, 6) AS best_val_loss, round(ls.loss, 6) AS test_loss
FROM cf JOIN be USING (config_no) JOIN ls ON ls.config_no = cf.config_no AND ls.epoch = be.best_epoch AND ls.split = 'test'""")
def grid_search_q(spark, sf_dir):
    """ML-3: a 2x2 grid (step size x weight decay) of linear models on the split VEC (label parity as target), 20 epochs each,
    all from one aggregate; the best epoch by validation loss is tested."""
    from ..operators import grid as G

    vecs = B.vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("national_number"), "vec", (F.col("seq_id") % 2).alias("label"))
    axes = {"learning_rate": [0.5, 0.1], "weight_decay": [0.0, 0.01]}
    found = G.grid_search_from_moments(SP.three_way_split(vecs), "vec", "label", axes, 20, labels={"learning_rate": "lr", "weight_decay": "wd"})
    return found.select("config_no", "config_name", "learning_rate", "weight_decay", "best_epoch", *[F.round(c, 6).alias(c) for c in ("best_val_loss", "test_loss")])


@query("checkpoint_folders", with_(Q.LOG, """ep AS (SELECT DISTINCT config, epoch FROM log)""", """ck AS (
  SELECT config, 'model_epoch_' || CAST(epoch AS VARCHAR) || '.pt' AS name FROM ep
  UNION ALL SELECT DISTINCT config, 'best_model_epoch_40.pt' FROM ep
  UNION ALL SELECT DISTINCT config, 'model_epoch_31.pt.bak' FROM ep WHERE config = 'click')""", """p AS (
  SELECT config, name, CAST(regexp_extract(name, '^model_epoch_(\\d+)\\.pt', 1) AS BIGINT) AS epoch FROM ck WHERE regexp_matches(name, '^model_epoch_(\\d+)\\.pt'))""",
                                   """mx AS (SELECT config, max(epoch) AS me FROM p GROUP BY config)""") + """
SELECT p.config, min(p.name) AS name, p.epoch FROM p JOIN mx ON p.config = mx.config AND p.epoch = mx.me GROUP BY p.config, p.epoch""")
def checkpoint_folders(spark, sf_dir):
    """SC-10 + TK-1: checkpoints written to a folder per configuration, found again below one root, the newest of each."""
    from ..operators import metrics as MT

    root = scratch_path(spark, "checkpoints")
    written = B.checkpoints(spark, sf_dir).withColumn("value", F.concat_ws("/", "config", "name"))
    written.write.partitionBy("config", "name").text(root)
    return MT.latest_checkpoint(SA.scan_checkpoint_folders(spark, root).withColumnRenamed("folder", "config"))


@query("grid_search_models")
def grid_search_models(spark, sf_dir):
    """ML-3: a 2x2 grid (step size x regularization), one distributed FM fit per configuration on
    the train part of VEC (label parity as target) after 5, 10 and 20 steps; the best by validation loss is tested."""
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.functions import array_to_vector

    from ..operators import grid as G

    vecs = B.vectors(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("national_number"),
        array_to_vector("vec").alias("features"), (F.col("seq_id") % 2).cast("double").alias("label"))
    parts = SP.three_way_split(vecs).persist()
    train = parts.where(F.col("split") == "train")
    val = parts.where(F.col("split") == "val")
    test = parts.where(F.col("split") == "test")

    def fit(df, params):
        for epochs in (5, 10, 20):
            yield epochs, FMClassifier(solver="adamW", stepSize=params["learning_rate"], regParam=params["weight_decay"],
                                       maxIter=epochs, factorSize=4, seed=42).fit(df)

    def score(model, df):
        from pyspark.ml.functions import vector_to_array
        p = F.element_at(vector_to_array("probability"), 2)
        eps = F.lit(1e-12)
        loss = -(F.col("label") * F.log(F.greatest(p, eps)) + (1 - F.col("label")) * F.log(F.greatest(1 - p, eps)))
        row = model.transform(df).select(F.avg(loss).alias("loss"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("acc")).first()
        return {"loss": row["loss"], "accuracy": row["acc"]}

    axes = {"learning_rate": [0.1, 0.01], "weight_decay": [0.0, 0.01]}
    found = G.grid_search(spark, train, val, test, axes, fit, score, labels={"learning_rate": "lr", "weight_decay": "wd"})
    parts.unpersist()
    return found.select("config_no", "config_name", "learning_rate", "weight_decay", "best_epoch",
                        *[F.round(c, 6).alias(c) for c in ("best_val_loss", "test_loss", "test_accuracy")])
