"""X-1 (optional extension, not reference parity): improving epochs over a stream of
validation losses.

Per config, the best loss so far is kept in Spark-managed state
(``applyInPandasWithState``); each micro-batch emits the rows that strictly improve on it.
Epochs of one config are expected to arrive in order across micro-batches (a training job
appends them as it goes); within a micro-batch they are sorted.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUTPUT_SCHEMA = "config string, epoch int, val_loss double, best_name string"
STATE_SCHEMA = "best double"


def improving_epochs(stream: DataFrame, group_col: str = "config", order_col: str = "epoch",
                     value_col: str = "val_loss") -> DataFrame:
    def step(key, pdfs, state):
        best = state.get[0] if state.exists else math.inf
        rows = []
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(order_col)
        for r in batch.itertuples(index=False):
            v = getattr(r, value_col)
            v = math.inf if v is None or (isinstance(v, float) and math.isnan(v)) else v
            if v < best:
                best = v
                e = int(getattr(r, order_col))
                rows.append((key[0], e, getattr(r, value_col), f"best_model_epoch_{e}.pt"))
        state.update((best,))
        yield pd.DataFrame(rows, columns=[group_col, order_col, value_col, "best_name"])

    return stream.groupBy(group_col).applyInPandasWithState(
        step, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
