"""Batch scoring with a caller-supplied model and the evaluation report (ML-1, ML-2, ML-5,
JN-5, JN-6, AG-1..AG-4).

``batch_score`` wraps ``pyspark.ml.functions.predict_batch_udf``: Spark ships Arrow batches of
``batch_size`` rows to the Python workers and the model is built once per worker by
``make_predict_fn`` (the reference's ``no_grad`` loop over a loader). Predictions and ground
truth are paired by id (an equi-join), never by position in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as V


def batch_score(df: DataFrame, make_predict_fn: Callable, input_col: str, out_col: str,
                return_type: T.DataType, batch_size: int = 10, width: int | None = None) -> DataFrame:
    """ML-1: apply a model to every row, ``batch_size`` rows per call, no gradients."""
    shapes = [[width]] if width else None
    udf = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size,
                            input_tensor_shapes=shapes)
    return df.withColumn(out_col, udf(F.col(input_col)))


def linear_scorer(weights) -> Callable:
    """A fixed linear model ``x -> x . w`` as a ``predict_batch_udf`` factory."""
    w = np.asarray(weights, dtype=np.float64)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return x.reshape(len(x), -1) @ w
        return predict
    return make


def scaling_model(factor: float) -> Callable:
    """A fixed linear map ``x -> factor * x`` producing vectors (a stand-in generator)."""
    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return factor * x.reshape(len(x), -1)
        return predict
    return make


def pair_metrics(pairs: DataFrame, pred_col: str = "pred", truth_col: str = "truth") -> DataFrame:
    """JN-5/JN-6 + AG-1 + FN-4 per pair: ``l1`` and ``cosine``."""
    return pairs.withColumn("l1", V.mean_abs_diff(pred_col, truth_col)).withColumn(
        "cosine", V.cosine(pred_col, truth_col))


def evaluation_report(scored: DataFrame, batch_col: str = "batch_id", pred_col: str = "pred",
                      truth_col: str = "truth") -> DataFrame:
    """ML-2: one row ``(test_loss, similarity_avg)``.

    test loss = size-weighted mean of batch mean L1 (AG-2); similarity = mean cosine (AG-3).
    Both come out of one two-level aggregation (per batch, then overall): no join.
    """
    m = pair_metrics(scored, pred_col, truth_col)
    per_batch = m.groupBy(batch_col).agg(
        F.avg("l1").alias("_bm"), F.count(F.lit(1)).alias("_bn"), F.sum("cosine").alias("_cs"))
    return per_batch.agg(
        (F.sum(F.col("_bm") * F.col("_bn")) / F.sum("_bn")).alias("test_loss"),
        (F.sum("_cs") / F.sum("_bn")).alias("similarity_avg"))


def similarity_summary(pairs: DataFrame) -> DataFrame:
    """AG-3/AG-4: mean similarity and the similarity loss ``1 - mean``."""
    m = pair_metrics(pairs)
    return m.agg(F.avg("cosine").alias("mean_similarity"),
                 (F.lit(1.0) - F.avg("cosine")).alias("similarity_loss"))
