"""X-3 (optional extension): new-file ingestion of ``;`` metadata files.

The same CSV options as the batch scan (SC-1), as a file stream with a declared schema; each
micro-batch can be handed to the batch preparation plan with ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.metadata import _CSV_OPTIONS


def metadata_stream(spark: SparkSession, folder: str, schema, sep: str = ";") -> DataFrame:
    return (spark.readStream.options(**_CSV_OPTIONS).option("sep", sep).schema(schema)
            .option("maxFilesPerTrigger", 100).csv(folder))
