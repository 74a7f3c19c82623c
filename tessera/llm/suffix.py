"""Suffix-array dedup: prefix doubling over the string starts that can repeat.

Every string of ``length`` bytes that starts in a document and also in one of smaller id is removed there.
Ranks (names) of strings grow from short prefixes to the threshold, and Spark sorts positions by rank at every
step; a position whose rank is unique is done and drops out.

Ranking each byte of a corpus at each step would move a row per byte and step. The first step therefore ranks string
starts in groups: all neighbouring starts whose strings have one least ``SEED``-byte substring (by hash), which equal
strings share. A group is a row (about 6 in 100 bytes): its seed is the rank, and the bytes that its strings cover are
the next rank. Rows with a unique seed drop out. Rows whose covered bytes stand in a document of smaller id are
repeats as a whole. Of the rest, only groups with a seed in common but other bytes around go on to the last step, where
each string start is a position of its own, ranked at the full length.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; ids are compared by ``<``, so rows of
one id are no repeats of each other and a null id comes last; equal rows stay as many rows. Other columns are passed through by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.arrow import pieces
from tessera.llm.common import byte_size, settled, sized
from tessera.llm.hashing import prefix_sums, span_hashes

LENGTH = 50
#: Bytes of a seed. Longer ones make more groups, shorter ones more chance matches.
SEED = 20


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (width - span)], x[width - span:]) if width > span else x


def groups(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, first start in it, number of starts, seed rank, rank of the covered bytes) of each group."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(data)
    if n < length:
        return none
    total = prefix_sums(data)
    at = np.arange(n - seed + 1)
    name = span_hashes(data, at, at + seed, total)
    # Bytes to the end of the text, per position.
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    left = starts[row + 1] - np.arange(n)
    name[left[:len(name)] < seed] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = sliding_least(name, length - seed + 1)
    valid = left[:len(least)] >= length
    same = np.zeros(len(least), bool)
    same[1:] = (least[1:] == least[:-1]) & valid[1:] & valid[:-1] & (row[1:len(least)] == row[:len(least) - 1])
    begin = np.flatnonzero(valid & ~same)
    if not len(begin):
        return none
    # A group ends before the next one begins, or where its text has no more starts.
    last = np.flatnonzero(valid & ~np.r_[same[1:], False])
    covered = span_hashes(data, begin, last + length, total)
    return row[begin], begin - starts[row[begin]], last - begin + 1, least[begin].view(np.int64), covered.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def repeats(rows: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """For rows (doc_id, text_key, text): whole copies, and (doc_id, text_key, starts, ends) removed."""
    names = rows.select("doc_id", "text_key", byte_size(F.col("text")).alias("n_bytes"))
    firsts = names.where(F.col("n_bytes") >= length).groupBy("text_key", "n_bytes").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("k")).where("k > 1")
    copies = settled(names.join(firsts, ["text_key", "n_bytes"]).where(F.col("doc_id").isNull() & F.col("first_id").isNotNull() | (F.col("doc_id") > F.col("first_id")))
                     .select("doc_id", "text_key").distinct(), "suffix-copies")
    # An id names a text, unless rows with different texts share one.
    clash = names.select("doc_id", "text_key").distinct().groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    is_copy = rows["doc_id"].eqNullSafe(F.col("c_id")) & (rows["text_key"] == F.col("c_key"))
    single = rows.join(sized(copies.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"))), is_copy, "left_anti")
    ident = ["doc_id", "text_key"] if clash else ["doc_id"]
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in pieces(batch.column(batch.num_columns - 1)):
                row, at, n, name, covered = groups(data, starts, length, seed)
                who = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(who) for i in range(len(ident))], pa.array(name), pa.array(covered), pa.array(at << 32 | n)],
                                                 names=[*ident, "seed", "covered", "place"])

    kind = f"doc_id {id_type}, " + ("text_key long, " if clash else "")
    found = single.select(*ident, "text").mapInArrow(seeds, kind + "seed long, covered long, place long")
    # One shuffle by seed serves both windows.
    by_seed, by_bytes = W.partitionBy("seed"), W.partitionBy("seed", "covered")
    ranked = found.withColumn("alike", F.min("covered").over(by_seed) == F.max("covered").over(by_seed)).withColumn("first_id", F.min("doc_id").over(by_bytes))
    later = (F.col("doc_id") > F.col("first_id")) | (F.col("doc_id").isNull() & F.col("first_id").isNotNull())
    ranked = ranked.withColumn("later", F.coalesce(later, F.lit(False))).where(F.col("later") | ~F.col("alike"))
    ranked = settled(ranked.select(*ident, "later", F.shiftright("place", 32).cast("int").alias("at"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("n")), "suffix-groups")
    whole = ranked.where("later").select(*ident, "at", (F.col("at") + F.col("n") - 1 + length).alias("end"))

    # The last step: each start of what is left is ranked at the full length.
    open_ = ranked.where("NOT later").groupBy(*ident).agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))  # within one text
    open_ = open_.select(*[F.col(c).alias(f"o_{c}") for c in ident], "at", "n")
    mine = F.lit(True)
    for c in ident:
        mine = mine & single[c].eqNullSafe(F.col(f"o_{c}"))
    texts = single.join(open_, mine).select(*ident, "at", "n", "text")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(ident)
            for first, last, data, starts in pieces(batch.column(k + 2)):
                total = prefix_sums(data)
                for r in range(first, last):
                    at, n = (np.asarray(batch.column(k + i)[r].values).astype(np.int64) for i in range(2))
                    place = np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    begin = place + starts[r - first]
                    name = span_hashes(data, begin, begin + length, total).view(np.int64)
                    who = pa.array(np.full(len(place), r))
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(who) for i in range(k)], pa.array(name), pa.array(place.astype(np.int32))], names=[*ident, "name", "at"])

    each = texts.mapInArrow(strings, kind + "name long, at int")
    each = each.withColumn("first_id", F.min("doc_id").over(W.partitionBy("name"))).where(
        (F.col("doc_id") > F.col("first_id")) | (F.col("doc_id").isNull() & F.col("first_id").isNotNull()))
    parts = settled(each.select(*ident, "at", (F.col("at") + length).alias("end")), "suffix-strings")
    spans = whole.unionByName(parts).groupBy(*ident).agg(F.collect_list("at").alias("starts"), F.collect_list("end").alias("ends"))  # within one text
    if not clash:
        spans = spans.withColumn("text_key", F.lit(None).cast("long"))
    return copies, spans


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, not touching spans that cover the same."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], np.r_[ends[:-1][new[1:]], ends[-1]]


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` without the bytes that repeat a document of smaller id.

    The kept bytes of a text may end inside a character; such broken ones are dropped from the text. ``report``:
    instead doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes themselves.
    """
    rows = _keyed(docs, id_col, text_col)
    copies, spans = repeats(rows, length)
    other = [c for c in docs.columns if c != text_col]
    own = F.struct(F.col(id_col)) if report else F.struct(*[F.col(f"`{c}`") for c in other])
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), own.alias("own"), F.col(text_col).cast("string").alias("text"))
    copies = sized(copies.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")))
    base = base.join(copies, base["doc_id"].eqNullSafe(F.col("c_id")) & (base["text_key"] == F.col("c_key")), "left").withColumn("copy", F.col("c_key").isNotNull())
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"), "starts", "ends")
    mine = base["doc_id"].eqNullSafe(F.col("s_id")) & (F.col("s_key").isNull() | (base["text_key"] == F.col("s_key")))
    joined = base.join(spans, mine, "left").select("own", "copy", F.when(~F.col("copy"), F.col("starts")).alias("starts"), F.when(~F.col("copy"), F.col("ends")).alias("ends"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(4)
            for first, last, data, starts in pieces(text):
                cols: list[list] = [[] for _ in range(5)]
                for r in range(first, last):
                    part = data[starts[r - first]:starts[r - first + 1]]
                    a, b = batch.column(2)[r].values, batch.column(3)[r].values
                    if batch.column(1)[r].as_py():
                        kept, n, cut = b"", 1, len(part)
                    elif a is not None and len(a):
                        x, y = merged(np.asarray(a).astype(np.int64), np.asarray(b).astype(np.int64))
                        bounds = np.r_[0, np.c_[x, y].ravel(), len(part)]
                        kept = b"".join(part[bounds[i]:bounds[i + 1]].tobytes() for i in range(0, len(bounds), 2))
                        n, cut = len(x), int((y - x).sum())
                    else:
                        kept, n, cut = part.tobytes(), 0, 0
                    for c, v in zip(cols, (len(part), cut, n, hashlib.sha256(kept).hexdigest(), None if report or not text[r].is_valid else kept.decode("utf-8", "ignore"))):
                        c.append(v)
                arrays = [batch.column(0).slice(first, last - first), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["own", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    kind = joined.schema["own"].dataType.simpleString()
    out = joined.mapInArrow(work, f"own {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    if report:
        return out.select(F.col(f"own.`{id_col}`").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return out.select(*[(F.col("text") if c == text_col else F.col(f"own.`{c}`")).alias(c) for c in docs.columns])
