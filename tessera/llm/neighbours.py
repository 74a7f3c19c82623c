"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) takes a unit vector
to one whose nearest signed axis is its bucket; several rotations make several tables. A query probes
the axes nearest to it in every table, and what it meets is ranked by exact inner products.

The largest inner product becomes the smallest angle by one more coordinate: an indexed vector x gets
``sqrt(M^2 - |x|^2)``, a query gets 0. M is the largest norm of the vector's band: norms are banded by factors of
sqrt(2) below the largest, so that long vectors do not send the others into one bucket, and a query probes every band.
A query that finds fewer than ``top`` rows in its buckets is compared with all rows, in blocks too.

Equal vectors are one class, searched once; of a class only its ``top + 1`` smallest ids can be in an
answer, so no more are kept, and nothing is lost. A bucket is joined in blocks of bounded size on both sides
(index rows dealt by hash, probes by another), whatever its share of the rows; every index row of a probed
bucket is met. Each block keeps a query's best ``top + 1``, of equal scores the classes of smallest ids, which is all that the final merge can use.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part;
an inner product needs two vectors of one length, so each length is searched by itself, one after the other (a table
has one, or a few); ties go to the smaller id; with fewer candidates than ``top`` all of them are returned; rows that
share an id and a vector are one row; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import sized, written

#: Tables, and the share of a table's buckets that a query probes. Measured recall: see the README.
TABLES = 10
PROBE_SHARE = 1 / 8
ROUNDS = 3
TOP = 20
#: Rows of a block of the join: index rows and probes.
INDEX_BLOCK, PROBE_BLOCK = 8192, 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    signs = np.random.default_rng(table)
    for _ in range(ROUNDS):
        x = hadamard(x * signs.choice([-1.0, 1.0], x.shape[1]))
    return x


def _padded(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
    d = x.shape[1] + 1
    out = np.zeros((len(x), 1 << (d - 1).bit_length()))
    out[:, :d - 1] = x
    out[:, d - 1] = extra
    return out


def buckets(x: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Bucket of each indexed vector (largest norm of its band) in each table: the axis, plus the dimension if negative."""
    x = _padded(x, np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0)))
    out = np.empty((len(x), TABLES), np.int32)
    for t in range(TABLES):
        y = rotate(x, t)
        axis = np.abs(y).argmax(axis=1)
        out[:, t] = np.where(y[np.arange(len(y)), axis] >= 0, axis, axis + y.shape[1])
    return out


def probes(x: np.ndarray) -> np.ndarray:
    """(query, table, place): the buckets that each query probes, nearest axis first."""
    x = _padded(x, np.zeros(len(x)))
    n = max(1, int(2 * x.shape[1] * PROBE_SHARE))
    out = np.empty((len(x), TABLES, n), np.int32)
    for t in range(TABLES):
        y = rotate(x, t)
        out[:, t] = np.argsort(-np.concatenate([y, -y], axis=1), axis=1, kind="stable")[:, :n]
    return out


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of ``vectors`` nearest to each of ``queries``.

    Both have an id and an array of float or double; a query's own id is no candidate.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vec_col).cast("array<double>")
        square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)  # null or NaN if a component is
        return (df.where(F.col(id_col).isNotNull() & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"), square.alias("square"))
                .where(F.col("square").isNotNull() & ~F.isnan("square") & (F.col("square") > 0) & (F.col("square") < float("inf")))
                .withColumn("class", F.xxhash64("vec", F.size("vec"))))

    rows, asked = usable(vectors), usable(queries)
    # A row per length of vectors; lengths that no query has are never searched.
    wanted = {r["dim"] for r in asked.select(F.size("vec").alias("dim")).distinct().collect()}
    shapes = rows.groupBy(F.size("vec").alias("dim")).agg(F.max("square").alias("square")).orderBy("dim").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_of_one_length(*(t.where(F.size("vec") == r["dim"]) for t in (rows, asked)), r["dim"], float(np.sqrt(r["square"])), top)
             for r in shapes if r["dim"] in wanted]
    return reduce(DataFrame.unionByName, found) if found else out


def _of_one_length(rows: DataFrame, asked: DataFrame, dim: int, largest: float, top: int) -> DataFrame:
    """The answers to ``asked`` among ``rows`` (vec_id, vec, square, class), all vectors of length ``dim``."""
    # Of equal vectors the smallest ids; Spark limits each group before it shuffles.
    smallest = F.row_number().over(W.partitionBy("class").orderBy("vec_id"))
    members = written(rows.select("class", "vec_id").distinct().withColumn("r", smallest).where(F.col("r") <= top + 1).drop("r"), "ann-members")
    band = F.floor(2 * F.log2(F.lit(largest) / F.sqrt("square")))
    vec_of = written(rows.withColumn("band", band).groupBy("class").agg(F.min("vec_id").alias("least"), F.any_value("vec").alias("vec"), F.any_value("band").alias("band"), F.any_value("square").alias("square")), "ann-classes")
    # A row per band: two for each power of two between the norms.
    bands = {r["band"]: float(np.sqrt(r["square"])) for r in vec_of.groupBy("band").agg(F.max("square").alias("square")).collect()}
    wanted = written(asked.groupBy("class").agg(F.any_value("vec").alias("vec")), "ann-queries")

    def floats(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(len(column), dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = buckets(floats(batch.column(1)), np.array([bands[k] for k in batch.column(2).to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(list(b), pa.list_(pa.int32()))], names=["class", "vec", "band", "least", "b"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = probes(floats(batch.column(1)))
                flat = (b + (np.arange(TABLES) << 20)[None, :, None]).reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(flat), pa.list_(pa.int32()))], names=["class", "vec", "b"])

    kind = "class long, vec array<double>, b array<int>"
    stored = vec_of.select("class", "vec", "band", "least").mapInArrow(index, "class long, vec array<double>, band long, least long, b array<int>").select(
        "class", "vec", "band", "least", F.posexplode("b").alias("t", "b")).select("class", "vec", "band", "least", (F.col("t") * (1 << 20) + F.col("b")).alias("bucket"))
    probing = wanted.mapInArrow(probe, kind).select("class", "vec", F.explode("b").alias("bucket"))
    # A row per band and bucket: TABLES times twice the dimension for each band.
    held = stored.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    asks = probing.groupBy("bucket").agg(F.count("*").alias("q"))
    blocks = written(held.join(asks, "bucket").select("band", "bucket", F.ceil(F.col("n") / INDEX_BLOCK).cast("int").alias("parts"),
                                                     F.ceil(F.col("q") / PROBE_BLOCK).cast("int").alias("turns")), "ann-blocks")
    grid = sized(blocks)
    place = ["band", "bucket", "part", "turn"]
    stored = stored.join(grid, ["band", "bucket"]).withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int")) \
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select(*place, "class", "vec", "least")
    probing = probing.join(grid, "bucket").withColumn("turn", F.pmod(F.xxhash64("class", F.lit(1)), "turns").cast("int")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*place, "class", "vec")

    def nearest(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(x):
            x = x.sort_values("class")
            a, b = np.stack(q["vec"].to_numpy()), np.stack(x["vec"].to_numpy())
            names, least = x["class"].to_numpy(), x["least"].to_numpy()
            length = np.sqrt((b * b).sum(axis=1)).max()
            take = min(top + 1, len(b))
            for k in range(0, len(a), 256):
                s = a[k:k + 256] @ b.T
                # The product may differ from the exact score by rounding, so ties are told from what is near the last place.
                last = np.partition(s, len(b) - take, axis=1)[:, len(b) - take]
                slack = 1e-12 * length * np.sqrt((a[k:k + 256] ** 2).sum(axis=1))
                for j, name in enumerate(q["class"].to_numpy()[k:k + 256]):
                    best = np.flatnonzero(s[j] >= last[j] - slack[j])
                    # The exact score of a pair doesn't depend on the block that it is met in.
                    exact = (a[k + j] * b[best]).sum(axis=1)
                    order = np.lexsort((least[best], -exact))[:take]
                    out.append((name, names[best[order]], exact[order], least[best[order]]))
        return pd.DataFrame({"query": [o[0] for o in out], "class": [o[1] for o in out], "score": [o[2] for o in out], "least": [o[3] for o in out]})

    ids = asked.select(F.col("class").alias("query"), F.col("vec_id").alias("query_id")).distinct()

    def answers(probing: DataFrame, stored: DataFrame) -> DataFrame:
        """(query, query_id, rank, vec_id, score) of what ``probing`` meets in ``stored``, block by block."""
        met = probing.groupBy(*place).cogroup(stored.groupBy(*place)).applyInPandas(nearest, "query long, class array<long>, score array<double>, least array<long>")
        # TABLES * probes * (top + 1) entries a query and band at most, for each block a bucket is dealt into.
        merged = met.select("query", F.arrays_zip("score", F.transform("least", F.bitwise_not).alias("before"), "class").alias("found")).groupBy("query").agg(
            F.sort_array(F.flatten(F.collect_list("found")), asc=False).alias("found"))
        # Of equal scores the class of the smallest id comes first. Sorted, what was met more than once stands together.
        fresh = F.filter("found", lambda x, i: (i == 0) | (x != F.get(F.col("found"), i - 1)))
        merged = merged.select("query", F.slice(fresh, 1, top + 1).alias("found"))
        ranked = merged.select("query", F.inline("found")).join(members, "class")
        order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ranked = ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).select("query", "vec_id", "score")
        each = ids.join(ranked, "query").where("vec_id != query_id")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query", "query_id", "rank", "vec_id", "score")

    first = written(answers(probing, stored), "ann-answers")
    result = ["query_id", "rank", "vec_id", "score"]
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= top)
    short = written(ids.join(full, "query_id", "left_anti"), "ann-short")
    if not short.limit(1).count():
        return first.select(*result)
    # Too few rows met: all rows, in blocks.
    again = wanted.join(short.select(F.col("query").alias("class")).distinct(), "class", "left_semi")
    parts, turns = (max(1, -(-df.count() // size)) for df, size in ((vec_of, INDEX_BLOCK), (again, PROBE_BLOCK)))
    one = [F.lit(0).alias("band"), F.lit(0).alias("bucket")]
    dealt = lambda seed, n: F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = vec_of.select(*one, dealt(0, parts).alias("part"), every(turns).alias("turn"), "class", "vec", "least")
    probing = again.select(*one, every(parts).alias("part"), dealt(1, turns).alias("turn"), "class", "vec")
    whole = answers(probing, stored).join(short.select("query_id"), "query_id", "left_semi")
    return first.join(short.select("query_id"), "query_id", "left_anti").unionByName(whole).select(*result)
