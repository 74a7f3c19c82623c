"""Hyper-parameter grid, result table and grid search (JN-7, PR-11, TK-3, ML-3, ML-4).

The grid is a handful of parameter combinations, built on the driver from the axis lists (its
size is the product of the axis lengths, a parameter, never data). Each configuration's fit is a
distributed Spark ML job over the feature DataFrame; only the loop over configurations runs on
the driver, as in any grid search.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The reference's grid axes, in their order (the last axis varies fastest), and
# the short label each axis has in a configuration name.
GRID_AXES: dict[str, list] = {
    "learning_rate": [1e-4, 1e-5],
    "weight_decay": [1e-6, 1e-5],
    "n_heads_encoder": [2, 4],
    "dim_feedforward_encoder": [512, 1024],
    "num_transformers_encoder_layers": [2, 3],
}
AXIS_LABELS = {
    "learning_rate": "lr",
    "weight_decay": "wd",
    "n_heads_encoder": "nhe",
    "dim_feedforward_encoder": "dfn",
    "num_transformers_encoder_layers": "ntel",
}
# Fixed value: what configuration names begin with.
NAME_PREFIX = "ft_"


def config_name(values: dict, labels: dict = AXIS_LABELS, prefix: str = NAME_PREFIX) -> str:
    """PR-11: ``ft_lr_0.0001_wd_1e-06_...``; numbers print as Python prints them."""
    return prefix + "_".join(f"{labels[k]}_{v}" for k, v in values.items())


def grid_frame(spark: SparkSession, axes: dict[str, list] = GRID_AXES, labels: dict = AXIS_LABELS,
               prefix: str = NAME_PREFIX) -> DataFrame:
    """JN-7/TK-3: every combination with ``config_no`` in product order and ``config_name``."""
    names = list(axes)
    rows = []
    for i, combo in enumerate(itertools.product(*axes.values()), start=1):
        values = dict(zip(names, combo))
        rows.append((i, config_name(values, labels, prefix), *combo))
    fields = [T.StructField("config_no", T.LongType(), False), T.StructField("config_name", T.StringType(), False)]
    for n in names:
        is_float = any(isinstance(v, float) for v in axes[n])
        fields.append(T.StructField(n, T.DoubleType() if is_float else T.LongType(), False))
    return spark.createDataFrame([tuple(float(v) if isinstance(v, float) else v for v in r) for r in rows],
                                 T.StructType(fields))


# The columns of the result table.
RESULT_COLUMNS = ["config_name", "learning_rate", "weight_decay", "best_val_loss", "test_loss", "clip_score_avg"]


def result_table(grid: DataFrame, metrics: DataFrame, key: str = "config_no") -> DataFrame:
    """ML-4: the six result columns, plus the three axes the reference leaves out of its table.

    Every configuration has its row; one without metrics has nulls.
    """
    extra = [c for c in grid.columns if c not in RESULT_COLUMNS and c != key]
    return grid.join(metrics, key, "left").select(*RESULT_COLUMNS, *extra)


def grid_search(spark: SparkSession, train: DataFrame, val: DataFrame, test: DataFrame,
                axes: dict[str, list], fit: Callable[[DataFrame, dict], Iterable[tuple[int, object]]],
                score: Callable[[object, DataFrame], dict], labels: dict = AXIS_LABELS, parallel: int = 4) -> DataFrame:
    """ML-3: per configuration the models of its epochs, the best of them by validation loss, and its test scores.

    ``fit(train, params)`` yields ``(epoch, model)``; ``score(model, df) -> {"loss": .., "accuracy": ..}``. A NaN loss never
    is the best. Fits are distributed jobs; at most ``parallel`` configurations are under way at a time.
    The result has a row per configuration: its axes, ``best_epoch, best_val_loss, test_loss, test_accuracy``.
    """
    grid = grid_frame(spark, axes, labels)

    def one(row):
        params = {k: row[k] for k in axes}
        best = (math.inf, None, None)
        for epoch, model in fit(train, params):
            loss = float(score(model, val)["loss"])
            if loss < best[0]:
                best = (loss, epoch, model)
        if best[2] is None:
            return row["config_no"], math.inf, None, None, None
        t = score(best[2], test)
        return row["config_no"], best[0], best[1], float(t["loss"]), float(t["accuracy"])

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        results = list(pool.map(one, grid.collect()))  # the grid: bounded by the product of the axis lengths
    schema = "config_no long, best_val_loss double, best_epoch int, test_loss double, test_accuracy double"
    return grid.join(spark.createDataFrame(results, schema), "config_no", "left")


def moments(df: DataFrame, features_col: str, label_col: str, group_col: str = "split") -> DataFrame:
    """``(group, i, j, s)``: sums over each group's rows of the products of all pairs of coordinates, ``i <= j``.

    Coordinates are the features, then a constant 1, then the label, so the sums hold the Gram matrix, the moments with the label and the
    number of rows. Every task adds up its batches as matrices, and the shuffle moves one row a task, group and pair. Features
    are arrays of one length.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(len(batch), -1)
            x = np.column_stack([x, np.ones(len(batch)), batch.column(2).to_numpy(zero_copy_only=False)])
            group = np.array(batch.column(0).to_pylist(), object)
            for g in set(group.tolist()):
                mine = x[group == g]
                total[g] = total.get(g, 0.0) + mine.T @ mine
        for g, gram in total.items():
            i, j = np.triu_indices(len(gram))
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(gram[i, j])],
                                             names=["group", "i", "j", "s"])

    rows = df.select(F.col(group_col).cast("string"), F.col(features_col).cast("array<double>"), F.col(label_col).cast("double"))
    return rows.mapInArrow(work, "group string, i int, j int, s double").groupBy("group", "i", "j").agg(F.sum("s").alias("s"))


def _gram(rows: list, group: str, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in rows:
        if r["group"] == group:
            out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def squared_loss(gram: np.ndarray, w: np.ndarray) -> float:
    """Mean squared error of weights ``w`` (one per feature, and the constant) from the sums of a group; NaN without rows."""
    n = gram[-2, -2]
    v = np.append(w, -1.0)
    return float(v @ gram @ v / n) if n else math.nan


def descent(gram: np.ndarray, params: dict, epochs: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(epoch, weights)`` of full gradient steps of ridge regression, from zero weights, on a group's sums alone."""
    a, b = gram[:-1, :-1] / gram[-2, -2], gram[:-1, -1] / gram[-2, -2]
    w = np.zeros(len(b))
    for epoch in range(1, epochs + 1):
        w = w - params["learning_rate"] * (2 * (a @ w - b) + params["weight_decay"] * w)
        yield epoch, w


def grid_search_from_moments(df: DataFrame, features_col: str, label_col: str, axes: dict[str, list], epochs: int, split_col: str = "split",
                             labels: dict = AXIS_LABELS) -> DataFrame:
    """ML-3 with a fit that anyone can repeat: linear models by gradient descent, all configurations from one aggregate.

    The rows are read once, for :func:`moments` per split; every configuration's epochs, its validation loss after each of them and the
    test loss of the best one follow from these sums (features squared numbers on the driver, however many rows). A row per
    configuration: its axes, ``best_epoch`` (the first of least validation loss), ``best_val_loss``, ``test_loss``.
    """
    spark = df.sparkSession
    rows = moments(df, features_col, label_col, split_col).collect()  # a row per split and pair of features
    grid = grid_frame(spark, axes, labels)
    size = 1 + max((r["j"] for r in rows), default=1)
    train, val, test = (_gram(rows, g, size) for g in ("train", "val", "test"))
    results = []
    for row in grid.collect():  # the grid: bounded by the product of the axis lengths
        best = (math.inf, None, None)
        if train[-2, -2]:
            for epoch, w in descent(train, {k: row[k] for k in axes}, epochs):
                loss = squared_loss(val, w)
                if loss < best[0]:
                    best = (loss, epoch, w)
        results.append((row["config_no"], best[0], best[1], None if best[2] is None else squared_loss(test, best[2])))
    found = spark.createDataFrame(results, "config_no long, best_val_loss double, best_epoch int, test_loss double")
    return grid.join(found, "config_no", "left")
