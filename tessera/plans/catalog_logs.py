"""Queries over the loss log, validation curve and checkpoint bindings (LOG, LOGR, CK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import grid as G
from ..operators import metrics as MT
from ..operators import vectors as V
from ..operators.ranking import exact_rank
from . import sql_fragments as Q
from .catalog import query, with_

R6 = 6


def _weighted(spark, sf_dir):
    return MT.batch_weighted_loss(B.loss_log(spark, sf_dir))


WEIGHTED = [Q.LOG, """bt AS (SELECT config, epoch, split, batch_id, avg(item_loss) AS bm, count(*) AS bn FROM log GROUP BY ALL)""",
            """wl AS (SELECT config, epoch, split, sum(bm * bn) / sum(bn) AS loss FROM bt GROUP BY ALL)"""]


@query("sampled_epochs", with_(Q.LOG) + """
SELECT DISTINCT config, epoch FROM log WHERE epoch % 10 = 0""")
def sampled_epochs(spark, sf_dir):
    """PR-10: the epochs that get a visual sample (every 10th)."""
    log = B.loss_log(spark, sf_dir).select("config", "epoch")
    return MT.every_nth(log, "epoch", 10).distinct()


@query("weighted_loss", with_(*WEIGHTED) + """
SELECT config, epoch, split, round(loss, 6) AS loss FROM wl""")
def weighted_loss(spark, sf_dir):
    """AG-2: epoch loss per config and split = size-weighted mean of batch means."""
    return _weighted(spark, sf_dir).withColumn("loss", F.round("loss", R6))


@query("learning_curve", with_(*WEIGHTED) + """
SELECT config, epoch,
       round(max(CASE WHEN split = 'train' THEN loss END), 6) AS train_loss,
       round(max(CASE WHEN split = 'val' THEN loss END), 6) AS val_loss
FROM wl GROUP BY config, epoch""")
def learning_curve(spark, sf_dir):
    """WN-3: train and validation loss per epoch, side by side."""
    c = MT.learning_curve(_weighted(spark, sf_dir))
    return c.select("config", "epoch", F.round("train_loss", R6).alias("train_loss"),
                    F.round("val_loss", R6).alias("val_loss"))


@query("running_best", with_(Q.LOGR, """v AS (
  SELECT *, CASE WHEN val_loss IS NULL OR isnan(val_loss) THEN 'inf'::DOUBLE ELSE val_loss END AS vv FROM logr)""",
                             """b AS (
  SELECT *, coalesce(min(vv) OVER (PARTITION BY config ORDER BY epoch
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS prev
  FROM v)""") + """
SELECT config, epoch, round(val_loss, 6) AS val_loss, 'best_model_epoch_' || CAST(epoch AS VARCHAR) || '.pt' AS best_name
FROM b WHERE vv < prev""")
def running_best(spark, sf_dir):
    """WN-1/WN-4: epochs where the validation loss strictly improves, with the best-model name."""
    rb = MT.running_best(B.val_curve(spark, sf_dir))
    return rb.where("improved").select("config", "epoch", F.round("val_loss", R6).alias("val_loss"), "best_name")


@query("best_val_loss", with_(Q.LOGR) + """
SELECT config, round(coalesce(min(CASE WHEN isnan(val_loss) THEN 'inf'::DOUBLE ELSE val_loss END), 'inf'::DOUBLE), 6) AS best_val_loss
FROM logr GROUP BY config""")
def best_val_loss(spark, sf_dir):
    """WN-2: the final best per config (+inf when nothing improved)."""
    b = MT.best_value(B.val_curve(spark, sf_dir))
    return b.select("config", F.round("best_val_loss", R6).alias("best_val_loss"))


@query("latest_checkpoint", with_(Q.LOG, """ep AS (SELECT DISTINCT config, epoch FROM log)""", """ck AS (
  SELECT config, 'model_epoch_' || CAST(epoch AS VARCHAR) || '.pt' AS name FROM ep
  UNION ALL SELECT DISTINCT config, 'best_model_epoch_40.pt' FROM ep
  UNION ALL SELECT DISTINCT config, 'model_epoch_31.pt.bak' FROM ep WHERE config = 'click')""", """p AS (
  SELECT config, name, CAST(regexp_extract(name, '^model_epoch_(\\d+)\\.pt', 1) AS BIGINT) AS epoch
  FROM ck WHERE regexp_matches(name, '^model_epoch_(\\d+)\\.pt'))""",
                                  """mx AS (SELECT config, max(epoch) AS me FROM p GROUP BY config)""") + """
SELECT p.config, min(p.name) AS name, p.epoch FROM p JOIN mx ON p.config = mx.config AND p.epoch = mx.me
GROUP BY p.config, p.epoch""")
def latest_checkpoint(spark, sf_dir):
    """TK-1 / FN-2: newest ``model_epoch_<n>.pt`` per config folder."""
    return MT.latest_checkpoint(B.checkpoints(spark, sf_dir))


# Fixed values (oracle side): the grid's axes, the last one varying fastest.
_GRID = """grid AS (
  SELECT row_number() OVER (ORDER BY a.i, b.i, c.i, d.i, e.i) AS config_no,
         'ft_lr_' || a.n || '_wd_' || b.n || '_nhe_' || c.v || '_dfn_' || d.v || '_ntel_' || e.v AS config_name,
         a.v AS learning_rate, b.v AS weight_decay, c.v AS n_heads_encoder, d.v AS dim_feedforward_encoder, e.v AS num_transformers_encoder_layers
  FROM (VALUES (1, '0.0001', 0.0001), (2, '1e-05', 0.00001)) a(i, n, v), (VALUES (1, '1e-06', 0.000001), (2, '1e-05', 0.00001)) b(i, n, v),
       (VALUES (1, 2), (2, 4)) c(i, v), (VALUES (1, 512), (2, 1024)) d(i, v), (VALUES (1, 2), (2, 3)) e(i, v))"""


@query("grid_results", with_(*WEIGHTED, Q.PAIR_LONG,
                             """t AS (SELECT config, row_number() OVER (ORDER BY config) AS config_no FROM (SELECT DISTINCT config FROM log))""",
                             """bv AS (SELECT config, min(CASE WHEN isnan(loss) THEN 'inf'::DOUBLE ELSE loss END) AS best_val_loss FROM wl WHERE split = 'val' GROUP BY config)""",
                             """last AS (SELECT config, max(epoch) AS me FROM log GROUP BY config)""",
                             """tb AS (SELECT log.config, batch_id, avg(item_loss) AS bm, count(*) AS bn FROM log JOIN last ON log.config = last.config AND log.epoch = last.me GROUP BY ALL)""",
                             """tl AS (SELECT config, sum(bm * bn) / sum(bn) AS test_loss FROM tb GROUP BY config)""",
                             """cs AS (SELECT label, avg(c) AS clip FROM (SELECT id_pred, label, sum(p * t) / (sqrt(sum(p * p)) * sqrt(sum(t * t))) AS c FROM pl GROUP BY id_pred, label) GROUP BY label)""", _GRID) + """
SELECT g.config_name, CAST(g.learning_rate AS DOUBLE) AS learning_rate, CAST(g.weight_decay AS DOUBLE) AS weight_decay,
       round(bv.best_val_loss, 6) AS best_val_loss, round(tl.test_loss, 6) AS test_loss, round(cs.clip, 6) AS clip_score_avg,
       CAST(g.n_heads_encoder AS BIGINT) AS n_heads_encoder, CAST(g.dim_feedforward_encoder AS BIGINT) AS dim_feedforward_encoder,
       CAST(g.num_transformers_encoder_layers AS BIGINT) AS num_transformers_encoder_layers
FROM grid g
LEFT JOIN t ON t.config_no = g.config_no
LEFT JOIN bv ON bv.config = t.config LEFT JOIN tl ON tl.config = t.config
LEFT JOIN cs ON cs.label = g.config_no - 1""")
def grid_results(spark, sf_dir):
    """ML-4 / SC-9 data: the result table, a row for every configuration of the grid.

    Binding: configuration i is matched to the i-th event type in name order; best val loss =
    best epoch of the val curve; test loss = AG-2 over the config's final epoch; the similarity
    column = mean cosine of PAIR rows whose label is i - 1. What has no match has null metrics.
    """
    log = B.loss_log(spark, sf_dir)
    types = exact_rank(log.select("config").distinct(), ["config"], F.substring("config", 1, 2), rank_col="config_no", tiebreak=False)
    curve = MT.batch_weighted_loss(log).where(F.col("split") == "val")
    best = MT.best_value(curve, value_col="loss")
    last = log.groupBy("config").agg(F.max("epoch").alias("_last"))
    final = log.join(last, "config").where(F.col("epoch") == F.col("_last"))
    test = MT.batch_weighted_loss(final, keys=["config"], out_col="test_loss")
    losses = types.join(best, "config", "left").join(test, "config", "left").select(
        "config_no", F.round("best_val_loss", 6).alias("best_val_loss"), F.round("test_loss", 6).alias("test_loss"))
    pairs = B.pairs(spark, sf_dir).withColumn("cosine", V.cosine("pred", "truth"))
    clip = pairs.groupBy((F.col("label") + 1).cast("long").alias("config_no")).agg(F.round(F.avg("cosine"), 6).alias("clip_score_avg"))
    return G.result_table(G.grid_frame(spark), losses.join(clip, "config_no", "full"))
