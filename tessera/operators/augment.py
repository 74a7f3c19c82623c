"""Rotation fan-out of kept rows (AU-1..AU-3, ST-1).

Each kept row yields itself plus ``k`` augmented rows ``<padded>_aug<i>`` rotated by
``360 * i / (k + 1)`` degrees. The fan-out is one ``explode`` of a literal index array, so it
runs inside the scan stage: no shuffle, and no ``sequence(1, 0)`` trap for ``k = 0``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_id, padded_id


def fan_out(df: DataFrame, k: int, id_col: str = "national_number",
            splits: Sequence[str] | None = None, split_col: str = "split") -> DataFrame:
    """AU-1/2/3: add ``aug_no`` (0 = original) and ``angle``; replace the id on augmented rows.

    ``splits`` limits augmentation to those splits (None = every row, as the reference runs it).
    All other columns pass through unchanged (PR-14).
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    idx = F.array(*[F.lit(i) for i in range(k + 1)])
    if splits is not None and k > 0:
        idx = F.when(F.col(split_col).isin(list(splits)), idx).otherwise(F.array(F.lit(0)))
    out = df.select("*", F.explode(idx).alias("aug_no"))
    padded = padded_id(base_id(F.col(id_col).cast("string")), strict=True)
    new_id = F.when(F.col("aug_no") == 0, F.col(id_col)).otherwise(
        F.concat(padded, F.lit("_aug"), F.col("aug_no").cast("string")))
    angle = F.col("aug_no").cast("double") * F.lit(360.0) / F.lit(float(k + 1))
    return out.withColumn(id_col, new_id).withColumn("angle", angle)
