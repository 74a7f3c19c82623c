import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.augment import fan_out
from tessera.operators.ranking import exact_rank
from tessera.operators.split import epoch_shuffle, head_batches, mini_batches, three_way_split


def _ids(spark, n, parts=3):
    return spark.createDataFrame([(str(i),) for i in range(n)], "national_number string").repartition(parts)


@pytest.mark.parametrize("n,expected", [(10, (8, 1, 1)), (20, (16, 2, 2)), (100, (80, 10, 10)),
                                        (600, (479, 61, 60)), (151, (119, 16, 16)), (1025, (819, 103, 103))])
def test_split_sizes(spark, n, expected):
    s = three_way_split(_ids(spark, n))
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert (counts.get("train", 0), counts.get("val", 0), counts.get("test", 0)) == expected


@pytest.mark.parametrize("n", [1, 2])
def test_split_too_small_raises(spark, n):
    with pytest.raises(Exception, match="train set empty"):
        three_way_split(_ids(spark, n)).collect()


def test_split_disjoint_cover_and_partition_independent(spark):
    a = {r.national_number: r.split for r in three_way_split(_ids(spark, 300, 1)).collect()}
    b = {r.national_number: r.split for r in three_way_split(_ids(spark, 300, 7)).collect()}
    assert len(a) == 300 and a == b


def test_exact_rank_equals_global_window(spark):
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 1000).alias("k"), "id").repartition(5)
    r = exact_rank(df, [F.col("k"), F.col("id")], F.floor(F.col("k") / 100), rank_col="rk", total_col="n")
    w = df.withColumn("rk2", F.row_number().over(Window.orderBy("k", "id")))
    bad = r.join(w, ["k", "id"]).where((F.col("rk") != F.col("rk2")) | (F.col("n") != 2000)).count()
    assert bad == 0
    assert "InMemoryRelation" not in r._jdf.queryExecution().executedPlan().toString()


def test_exact_rank_with_hot_group(spark):
    # one group holds most rows; numbering per group still matches a window
    df = spark.range(0, 3000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.lit("cold")).alias("g"),
                                     "id")
    r = exact_rank(df, [F.col("id")], F.floor(F.col("id") / 100), partition_by=["g"], rank_col="rk")
    w = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert r.join(w, ["g", "id"]).where(F.col("rk") != F.col("rk2")).count() == 0


def test_epoch_shuffle_and_batches(spark):
    sh = epoch_shuffle(_ids(spark, 25), [1, 2])
    rows = sh.collect()
    for e in (1, 2):
        assert sorted(r.pos for r in rows if r.epoch == e) == list(range(1, 26))
    order1 = [r.national_number for r in sorted((r for r in rows if r.epoch == 1), key=lambda r: r.pos)]
    order2 = [r.national_number for r in sorted((r for r in rows if r.epoch == 2), key=lambda r: r.pos)]
    assert order1 != order2
    b = mini_batches(sh.where("epoch = 1"), 10)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [5, 10, 10]
    head = head_batches(b, 12, 10).collect()
    assert len(head) == 20 and sum(r.shown for r in head) == 12


def test_fan_out(spark):
    df = spark.createDataFrame([("25_1", "x")], "national_number string, other string")
    assert [r.national_number for r in fan_out(df, 0).collect()] == ["25_1"]
    rows = sorted(fan_out(df, 2).collect(), key=lambda r: r.aug_no)
    assert [r.national_number for r in rows] == ["25_1", "025_aug1", "025_aug2"]
    assert [r.angle for r in rows] == [0.0, 120.0, 240.0]
    assert all(r.other == "x" for r in rows)
    assert math.isclose(rows[1].angle, 360 * 1 / 3)


def test_split_moves_no_wide_column_and_caches_nothing(spark):
    df = _ids(spark, 200).withColumn("wide", F.lit("x"))
    plan = three_way_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryRelation" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "wide" in line]
    assert three_way_split(df).where("split = 'train'").count() == 160


def test_head_batches_take_all(spark):
    b = mini_batches(epoch_shuffle(_ids(spark, 25), [1]), 10)
    assert head_batches(b, None, 10).where("shown").count() == 25


def test_epoch_shuffle_keeps_other_columns(spark):
    rows = epoch_shuffle(_ids(spark, 12).withColumn("v", F.col("national_number").cast("int") * 2), [1, 2]).collect()
    assert len(rows) == 24 and all(r.v == 2 * int(r.national_number) for r in rows)


def test_lookups_fail_or_show_violators(spark):
    from tessera.operators.assets import resolve_assets, strict_lookup

    m = spark.createDataFrame([("7",), ("8",), ("abc",), (None,)], "national_number string")
    files = spark.createDataFrame([("007.png", "b/007.png"), ("007.png", "a/007.png")], "name string, path string")
    got = {r.national_number: (r.match_rank, r.asset_path) for r in resolve_assets(m, files).collect()}
    assert got == {"7": (1, "a/007.png"), "8": (None, None), "abc": (None, None), None: (None, None)}
    assert strict_lookup(m, files, fail=False).count() == 4
    with pytest.raises(Exception, match="Missing asset"):
        strict_lookup(m, files).collect()


def test_empty_split_fails(spark):
    from tessera.operators.metrics import require_rows

    df = spark.createDataFrame([("train",), ("val",)], "split string")
    with pytest.raises(Exception, match="splits are empty"):
        require_rows(df).collect()
    assert require_rows(df.union(spark.createDataFrame([("test",)], "split string"))).count() == 3
