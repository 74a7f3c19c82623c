import pyarrow.parquet as pq

import corpus_pipeline

from .conftest import EDGE_ROWS, SF


def test_stages(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = corpus_pipeline.written(docs, "test-stage")
        counts.append(docs.count())
    assert counts[0] == counts[1] > counts[2] > counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    sizes = [r["count"] for r in last.groupBy("shard").count().collect()]
    assert last.count() == counts[4] and max(sizes) - min(sizes) <= 1
    assert pq.read_table(f"{SF}/documents.parquet").num_rows == counts[0]


def test_edge_rows_pass(spark, edges):
    docs = edges.selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS long) AS n_chars")
    assert len(EDGE_ROWS) == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
    assert docs.count() > 0
    empty = edges.where("false").selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS long) AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, SF), "test-stage")
    assert empty.count() == 0
