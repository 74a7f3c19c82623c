"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, language, mixing, neighbours, secrets, shards, spans, suffix, suffix_tree

from .conftest import EDGE_ROWS, PASSAGE

EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="session")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "five six"), (4, "five six")], "item_id long, text string")


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_decontaminate(spark, edges, nothing, bench):
    got = decontaminate.report(edges, bench).collect()
    assert len(got) == len(EDGE_ROWS)
    of = lambda i: [r for r in got if r.doc_id == i]
    assert [(r.n_words, r.n_hit, r.items_sha256) for r in of(1) + of(2) + of(3)] == [(0, 0, EMPTY)] * 3
    assert len(of(5)) == 2 and all((r.n_words, r.n_hit, r.n_items) == (6, 2, 1) for r in of(5)) and not any(r.contaminated for r in of(6))
    assert of(8)[0].n_hit == of(8)[0].n_words and of(None)[0].contaminated and of(4)[0].n_words == 30_000
    assert decontaminate.report(nothing, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(edges, bench.where("false")).collect())
    wide = rows_of(decontaminate.report(edges, bench, broadcast_windows=0), "doc_id", "n_words", "n_hit", "items_sha256")
    assert wide == sorted(((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got), key=str)


def test_decontaminate_modes(spark, edges, nothing, bench):
    kept = decontaminate.decontaminate(edges, bench)
    assert kept.columns == edges.columns and kept.count() == len(EDGE_ROWS) - 5
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(edges, bench, mode="cut").collect()}
    assert cut[9] == "Été ÀÉ Straße £5 end" and cut[5] == "One two three four  ." and cut[1] is None and "passage" not in cut[7] and cut[7].startswith("Before it. ")
    assert decontaminate.decontaminate(nothing, bench, mode="cut").count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(edges, bench, mode="other")


def test_language(spark, edges, nothing):
    labelled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(labelled)
    got = language.identify(edges, model, host=F.col("source"))
    assert got.count() == len(EDGE_ROWS) and "own" in got.columns
    kept = language.keep_identified(edges, model, host=F.col("source"))
    assert kept.columns == edges.columns and {1, 2, 3} <= {r.doc_id for r in kept.collect()}
    assert language.identify(nothing, model).count() == 0 and language.keep_identified(nothing, model).count() == 0
    unfit = language.fit(labelled.where("false"))
    assert {r.lang for r in language.identify(edges, unfit).collect()} == {"und"}


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, []), (10, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, class string")
    got = neighbours.search(df, df).collect()
    one = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 1)
    assert one == [(1, 3, 2.0), (2, 2, 1.0), (3, 10, 0.0)]
    assert {r.query_id for r in got} <= {1, 2, 3, 10} and not {r.vec_id for r in got} & {4, 5, 6, 7, 8, 9}
    assert neighbours.search(df.where("false"), df).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0]), (3, [0.5, 0.5]), (4, [-2.0]), (5, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(mixed, mixed).collect())
    assert got == [(1, 1, 3, 0.5), (2, 1, 4, -6.0), (3, 1, 1, 0.5), (4, 1, 2, -6.0)]
    same = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(100)], "vec_id long, embedding array<double>")
    got = neighbours.search(same, same.where("vec_id in (0, 50)")).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: (r.query_id, r.rank))] == [*range(1, 21), *range(20)]


def test_suffix(spark, edges, nothing):
    got = suffix.remove(edges, report=True).collect()
    of = lambda i: sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got if r.doc_id == i)
    n = len(PASSAGE)
    assert len(got) == len(EDGE_ROWS) and of(1) == of(2) == [(0, 0, 0)] and of(8) == [(n, n, 1)] and len(of(5)) == len(of(6)) == 2
    assert of(4)[0][1] == 0 and of(10)[0][0] == of(10)[0][1] and of(None)[0][1] >= n
    out = suffix.remove(edges)
    assert out.columns == edges.columns and out.count() == len(EDGE_ROWS) and out.where("doc_id = 1 and text is null").count() == 1
    assert suffix.remove(nothing, report=True).count() == 0


def test_shards(spark, edges, nothing):
    got = shards.shard(edges, n_shards=4).collect()
    assert len(got) == len(EDGE_ROWS) and sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(3 + (s < 1))]
    assert [(r.size, r.text_crc32) for r in got if r.doc_id == 1] == [(16, 0)]
    assert shards.shard(nothing).count() == 0
    linked = shards.shard(edges, n_shards=2, link=F.col("source")).collect()
    assert sorted(r.shard for r in linked) == [0] * 7 + [1] * 6


def test_secrets(spark, edges, nothing):
    got = secrets.scan(edges).collect()
    assert len(got) == len(EDGE_ROWS) and {r.base_sha256 for r in got if r.doc_id in (1, 2, 3)} == {EMPTY}
    assert secrets.scan(nothing).count() == 0


def test_mixing(spark, edges, nothing):
    got = mixing.plan(edges).collect()
    assert len(got) == len(EDGE_ROWS) and all(r.size == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(r.repeats <= 3 for r in got)
    out = mixing.mix(edges)
    assert out.columns == edges.columns and out.count() == sum(r.repeats for r in got)
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_mixing_equal_rows_share_their_takes(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 7 + [(2, "d e", "t")] * 5, "doc_id long, text string, source string")
    n = {r.doc_id: r.n for r in mixing.plan(df).groupBy("doc_id").agg(F.sum("repeats").alias("n")).collect()}
    out = {r.doc_id: r["count"] for r in mixing.mix(df).groupBy("doc_id").count().collect()}
    assert {k: v for k, v in n.items() if v} == out


def test_jaccard(spark, edges, nothing):
    got = jaccard.similar_groups(edges).collect()
    of = lambda i: [(r.n_shingles, r.component_id) for r in got if r.doc_id == i]
    assert len(got) == len(EDGE_ROWS) and of(1) == [(0, 1)] and of(3) == [(0, 3)] and of(5) == [(4, 5)] * 2 and of(10) == [(29_998, 4)] and of(4) == [(29_998, 4)]
    kept = jaccard.keep_one(edges)
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert kept.columns == edges.columns and ids == sorted([1, 2, 3, 4, 5, 6, 6, 7, 9], key=str)
    assert jaccard.similar_groups(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0


def test_spans(spark, edges, nothing):
    got = spans.remove_repeats(edges, report=True).collect()
    assert len(got) == len(EDGE_ROWS) and [r.text for r in got if r.doc_id == 1] == [None]
    assert all(r.n_removed == r.n_sentences > 0 and r.text == "" for r in got if r.doc_id == 10) and all(r.n_removed == 0 for r in got if r.doc_id in (4, 5, 6))
    out = spans.remove_repeats(edges)
    assert out.columns == edges.columns and out.count() == len(EDGE_ROWS)
    assert spans.remove_repeats(nothing, report=True).count() == 0


def test_suffix_tree(spark, edges, nothing):
    got = suffix_tree.score(edges).collect()
    assert len(got) == len(EDGE_ROWS) and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert suffix_tree.score(nothing).count() == 0
    unlearnt = suffix_tree.score(edges.where("doc_id is null and false").unionByName(edges.where("doc_id = 2"))).collect()
    assert len(unlearnt) == 1
