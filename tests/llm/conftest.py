import pytest

SF = "/root/testdata/sf0.001"

#: Extra columns whose names the operators use themselves.
EXTRA = "key string, node int, words int, n int, row int, size string, text_key string, shard int, hits string, own int, copies int"


def texts_of(path=SF):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{path}/documents.parquet")
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def frame(spark, rows):
    """(doc_id, text, source) rows with extra columns of clashing names."""
    full = [(i, t, s, "k", 1, 2, 3, 4, "z", "tk", 7, "h", 8, 9) for i, t, s in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, source string, {EXTRA}").repartition(3)


LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
PASSAGE = "every one of these words stands in the passage that several different texts share in full length and in order today"

EDGE_ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, LONG, "b"), (5, "One two three four five six.", "b"),
    (5, "One two three four five six.", "b"), (6, "Other text under one id.", "c"), (6, "The second text of the id.", "c"),
    (None, "A row without id. " + PASSAGE, "c"), (7, "Before it. " + PASSAGE + " After it.", None), (8, PASSAGE, "d"), (9, "Été ÀÉ Straße £5 end", "d"),
    (10, LONG, "b"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGE_ROWS).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, EDGE_ROWS).where("false")
