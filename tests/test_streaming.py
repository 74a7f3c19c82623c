from pyspark.sql import functions as F

from tessera.operators.metrics import running_best
from tessera.session import scratch_path
from tessera.streaming.running_best import improving_epochs

from .conftest import SMOKE_DIR


def test_streaming_running_best_equals_batch(spark):
    from tessera.bindings import val_curve
    curve = val_curve(spark, SMOKE_DIR)
    folder = scratch_path(spark, "curve-stream")
    # two appends: epochs 1..100, then the rest (the stream sees them in order)
    # each append is one file, in epoch order, as a training job would write it
    curve.where("epoch <= 100").coalesce(1).sortWithinPartitions("epoch").write.parquet(f"{folder}/part=1")
    curve.where("epoch > 100").coalesce(1).sortWithinPartitions("epoch").write.parquet(f"{folder}/part=2")
    stream = spark.readStream.schema(curve.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    q = (improving_epochs(stream).writeStream.format("memory").queryName("rb_stream")
         .option("checkpointLocation", scratch_path(spark, "rb-ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.config, r.epoch) for r in spark.sql("SELECT * FROM rb_stream").collect()}
    want = {(r.config, r.epoch) for r in running_best(curve).where("improved").collect()}
    assert got == want and len(want) > 0
