"""The preparation step as one lazy plan.

metadata scan -> exact seeded split -> sprite lookup with fallback -> skip missing ->
rotation fan-out -> captions. Boundaries: the range exchange of the split, the two manifest
lookups (broadcast or sort-merge, chosen by AQE from runtime sizes), nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import assets as AS
from ..operators import augment as AU
from ..operators import split as SP
from ..operators.captions import caption_expr


def prepare(metadata: DataFrame, manifest: DataFrame, k: int = 0, seed: int = 42,
            val_ratio: float = 0.1, test_ratio: float = 0.1, splits=None, noun: str = "item") -> DataFrame:
    s = SP.three_way_split(metadata, val_ratio=val_ratio, test_ratio=test_ratio, seed=seed)
    kept = AS.resolved_rows(AS.resolve_assets(s, manifest))
    fanned = AU.fan_out(kept, k, splits=splits)
    return fanned.withColumn("caption", caption_expr(noun))


def prepared_training_set(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    out = prepare(B.metadata(spark, sf_dir), B.manifest(spark, sf_dir), k=k)
    return out.select("split", "national_number", "aug_no", "angle", "asset_name", "caption",
                      F.col("match_rank"))
