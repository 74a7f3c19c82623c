"""Loss aggregation, learning curves, running bests and checkpoint picks (AG-2, AG-5..8,
WN-1..4, TK-1, PR-10).

Everything is a grouped aggregate with map-side partial aggregation, or a window over groups
whose size is bounded by construction (blocks), so a config holding most of the log rows is
still processed by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import exact_rank
from .split import SPLITS

INF = float("inf")


def batch_weighted_loss(log: DataFrame, keys: Sequence[str] = ("config", "epoch", "split"),
                        batch_col: str = "batch_id", loss_col: str = "item_loss",
                        out_col: str = "loss") -> DataFrame:
    """AG-2: ``sum(mean_b * |b|) / sum(|b|)`` over the batches of each key group.

    Two hash aggregates with partial aggregation. An empty group yields no row (the reference
    divides by zero).
    """
    per_batch = log.groupBy(*keys, batch_col).agg(
        F.avg(loss_col).alias("_bm"), F.count(F.lit(1)).alias("_bn"))
    return per_batch.groupBy(*keys).agg(
        (F.sum(F.col("_bm") * F.col("_bn")) / F.sum("_bn")).alias(out_col))


def learning_curve(losses: DataFrame, keys: Sequence[str] = ("config", "epoch"),
                   split_col: str = "split", loss_col: str = "loss") -> DataFrame:
    """WN-3: train and validation loss side by side per epoch (pivot with fixed values)."""
    return (losses.groupBy(*keys).pivot(split_col, ["train", "val"]).agg(F.first(loss_col))
            .withColumnRenamed("train", "train_loss").withColumnRenamed("val", "val_loss"))


def every_nth(df: DataFrame, col: str, n: int) -> DataFrame:
    """PR-10: keep rows whose ``col`` is a multiple of ``n``."""
    return df.where(F.col(col) % n == 0)


def _nan_to_inf(c):
    return F.when(c.isNull() | F.isnan(c), F.lit(INF)).otherwise(c)


def running_best(curve: DataFrame, group_cols: Sequence[str] = ("config",), order_col: str = "epoch",
                 value_col: str = "val_loss", block_size: int = 4096) -> DataFrame:
    """WN-1/WN-4: running minimum and strict-improvement flag per group.

    Semantics: the best starts at +inf; a row improves when its value is strictly below the best
    of all earlier rows; NaN (and null) never improves. Adds ``best_before``, ``best``,
    ``improved``, ``ckpt_name`` (``model_epoch_<n>.pt``) and ``best_name``
    (``best_model_epoch_<n>.pt`` on improving rows).

    Rows of one ``order_col`` value are simultaneous: none of them is earlier than another.

    Plan: a partial aggregate leaves one minimum per value of ``order_col``, however many rows share
    it. These are cut into blocks of ``block_size`` values, and the blocks into blocks of as many
    blocks. A window inside a block, one over the blocks of a large block, and one over the large
    blocks give the minima of all that is earlier; the first two hold ``block_size`` rows at
    most, the last one row per ``block_size ** 2`` values.
    """
    g = list(group_cols)
    at = F.col(order_col)
    steps = curve.groupBy(*g, order_col).agg(F.min(_nan_to_inf(F.col(value_col))).alias("_rb_v")).withColumn(
        "_rb_1", F.floor(at / F.lit(block_size)).cast("bigint")).withColumn("_rb_2", F.floor(F.col("_rb_1") / F.lit(block_size)).cast("bigint"))
    small = steps.groupBy(*g, "_rb_2", "_rb_1").agg(F.min("_rb_v").alias("_rb_m"))
    large = small.groupBy(*g, "_rb_2").agg(F.min("_rb_m").alias("_rb_m"))

    def earlier(keys, order, value):
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.min(value).over(w), F.lit(INF))

    def renamed(df, keys, mark):
        return df.select(*[F.col(k).alias(f"{mark}{k}") for k in keys], *[c for c in df.columns if c not in keys])

    def same(left, keys, mark):
        cond = F.lit(True)
        for k in keys:
            cond = cond & left[k].eqNullSafe(F.col(f"{mark}{k}"))
        return cond

    k1, k2 = [*g, "_rb_2", "_rb_1"], [*g, "_rb_2"]
    small = renamed(small.select(*k1, earlier(k2, "_rb_1", "_rb_m").alias("_rb_p1")), k1, "_rb_s_")
    large = renamed(large.select(*k2, earlier(g, "_rb_2", "_rb_m").alias("_rb_p2")), k2, "_rb_l_")
    steps = steps.withColumn("_rb_p0", earlier(k1, order_col, "_rb_v"))
    steps = steps.join(small, same(steps, k1, "_rb_s_"))
    steps = steps.join(large, same(steps, k2, "_rb_l_"))
    before = steps.select(*g, order_col, F.least("_rb_p0", "_rb_p1", "_rb_p2").alias("best_before"))
    keys = [*g, order_col]
    joined = curve.join(renamed(before, keys, "_rb_r_"), same(curve, keys, "_rb_r_"))
    value = _nan_to_inf(F.col(value_col))
    improved = value < F.col("best_before")
    return joined.select(
        *curve.columns, "best_before", improved.alias("improved"), F.least(F.col("best_before"), value).alias("best"),
        F.format_string("model_epoch_%d.pt", at).alias("ckpt_name"),
        F.when(improved, F.format_string("best_model_epoch_%d.pt", at)).alias("best_name"))


def best_value(curve: DataFrame, group_cols: Sequence[str] = ("config",), value_col: str = "val_loss",
               out_col: str = "best_val_loss") -> DataFrame:
    """WN-2: final best per group; +inf when nothing ever improved (all NaN)."""
    return curve.groupBy(*group_cols).agg(
        F.coalesce(F.min(_nan_to_inf(F.col(value_col))), F.lit(INF)).alias(out_col))


# Fixed value: the file names that count as checkpoints.
CHECKPOINT_PATTERN = r"^model_epoch_(\d+)\.pt"


def latest_checkpoint(files: DataFrame, group_cols: Sequence[str] = ("config",), name_col: str = "name",
                      require: bool = True) -> DataFrame:
    """TK-1: per group, the file whose name starts with ``model_epoch_<n>.pt`` with the largest n.

    The pattern is anchored at the start only, so ``model_epoch_4.pt.bak`` counts and
    ``best_model_epoch_3.pt`` does not. Ties on n go to the smallest name. With ``require`` a
    group with no matching file fails the job (the reference raises).
    """
    g = list(group_cols)
    p = files.where(F.col(name_col).rlike(CHECKPOINT_PATTERN)).withColumn(
        "epoch", F.regexp_extract(name_col, CHECKPOINT_PATTERN, 1).try_cast("bigint"))
    best = p.groupBy(*g).agg(
        F.max("epoch").alias("epoch"),
        F.min_by(F.col(name_col), F.struct((-F.col("epoch")).alias("e"), F.col(name_col).alias("n"))).alias(name_col))
    if not require:
        return best.select(*g, name_col, "epoch")
    groups = files.select(*g).distinct()
    out = groups.join(best, g, "left")
    checked = F.when(F.col(name_col).isNull(),
                     F.raise_error(F.lit("No checkpoint files found"))).otherwise(F.col(name_col))
    return out.select(*g, checked.alias(name_col), "epoch")


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """AG-5: rows per split."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))


def require_rows(df: DataFrame, split_col: str = "split", expected: Sequence[str] = SPLITS) -> DataFrame:
    """AG-7: ``df``, or a failing job if an expected split has no row (one count per split)."""
    n = empty_splits(df, split_col, expected).scalar()
    return df.where(F.when(n > 0, F.raise_error(F.concat(n.cast("string"), F.lit(" splits are empty"))).cast("boolean")).otherwise(True))


def empty_splits(df: DataFrame, split_col: str = "split", expected: Sequence[str] = SPLITS) -> DataFrame:
    """AG-7: number of expected splits without rows (one row, never empty)."""
    counts = split_counts(df, split_col)
    present = counts.where(F.col(split_col).isin(list(expected))).agg(
        F.count_distinct(split_col).alias("k"))
    return present.select((F.lit(len(expected)) - F.col("k")).cast("bigint").alias("n_empty"))


def comparison_table(pairs: DataFrame, n: int | None, keys: Sequence[str] = ("config", "epoch", "split"), order_col: str = "id_pred",
                     bucket=None, rank_col: str = "rank") -> DataFrame:
    """SC-11: per key group the first ``n`` pairs by ``order_col`` with their rank; ``n=None`` takes all (SP-7).

    ``bucket`` must not decrease along ``order_col`` (see :func:`exact_rank`).
    """
    bucket = F.lit(0) if bucket is None else bucket
    ranked = exact_rank(pairs, [order_col], bucket, partition_by=list(keys), rank_col=rank_col)
    return ranked if n is None else ranked.where(F.col(rank_col) <= n)


def comparison_path(root, config, epoch, split):
    """PR-12: ``<root>/<config>/epoch_<n>/<split>/image_comparisons``, where a comparison table belongs."""
    return F.concat_ws("/", root, config, F.concat(F.lit("epoch_"), epoch.cast("string")), split, F.lit("image_comparisons"))
