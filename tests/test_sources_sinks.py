import os

import pytest
from pyspark.sql import functions as F

from tessera.operators.grid import grid_frame, result_table
from tessera.operators.metrics import latest_checkpoint
from tessera.session import scratch_path
from tessera.sources.assets import scan_checkpoints
from tessera.sources.metadata import read_metadata, write_results, write_splits, read_splits


def _local(path):
    return path.replace("file:", "")


def test_checkpoint_folder_scan(spark):
    folder = scratch_path(spark, "ckpt")
    os.makedirs(_local(folder))
    for n in ("model_epoch_2.pt", "model_epoch_10.pt", "best_model_epoch_99.pt"):
        open(f"{_local(folder)}/{n}", "wb").write(b"x")
    files = scan_checkpoints(spark, folder).withColumn("config", F.lit("c"))
    r = latest_checkpoint(files).first()
    assert (r.name, r.epoch) == ("model_epoch_10.pt", 10)


def test_checkpoint_folder_without_match_raises(spark):
    folder = scratch_path(spark, "ckpt-bad")
    os.makedirs(_local(folder))
    open(f"{_local(folder)}/best_model_epoch_3.pt", "wb").write(b"x")
    files = scan_checkpoints(spark, folder).withColumn("config", F.lit("c"))
    with pytest.raises(Exception, match="No checkpoint"):
        latest_checkpoint(files).collect()


def test_result_table_sink_roundtrip(spark):
    grid = grid_frame(spark)
    assert grid.count() == 32
    first = grid.orderBy("config_no").first()
    assert first.config_name == "ft_lr_0.0001_wd_1e-06_nhe_2_dfn_512_ntel_2"
    last = grid.orderBy(F.desc("config_no")).first()
    assert last.config_name == "ft_lr_1e-05_wd_1e-05_nhe_4_dfn_1024_ntel_3"
    metrics = spark.createDataFrame([(1, 0.5, 0.6, 0.7)], "config_no long, best_val_loss double, test_loss double, clip_score_avg double")
    res = result_table(grid, metrics)
    path = scratch_path(spark, "results")
    write_results(res, path)
    back = {r.config_name: r for r in spark.read.option("header", "true").csv(path).collect()}
    assert len(back) == 32 and float(back[first.config_name].best_val_loss) == 0.5 and back[last.config_name].best_val_loss is None


def test_split_csv_sink_keeps_text(spark):
    rows = [("007", 'a;b "q"\nline2', "train"), ("8", "  pad  ", "val"), ("9", None, "test")]
    df = spark.createDataFrame(rows, "national_number string, description string, split string")
    path = scratch_path(spark, "split-sink")
    write_splits(df, path)
    back = {r.national_number: (r.description, r.split) for r in read_splits(spark, path).collect()}
    assert back == {"007": ('a;b "q"\nline2', "train"), "8": ("  pad  ", "val"), "9": (None, "test")}
    only_val = read_splits(spark, path, splits=["val"]).collect()
    assert [r.national_number for r in only_val] == ["8"]
