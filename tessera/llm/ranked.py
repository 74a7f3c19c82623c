"""Ranked lexical search: the best documents of every item by an exact dual-tree search.

Terms are maximal runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case. A document's score
for an item is a sum over the item's terms of a weight (rarer terms weigh more) times a number that grows with the
term's occurrences and falls with the document's length: the product of two vectors of non-negative whole numbers, over the items' terms.

One pass over the texts keeps, of each document, its number of terms and the occurrences of item terms. These narrow rows
are written; sums over them give the corpus figures and each term's documents. The search reads them in chunks of bounded
size. Documents of a chunk form a hierarchy (halved by the term that half of a node's documents hold), and so do the items; a node
holds the maximum of each coordinate over its rows, so the product of an item node's and a document node's maxima bounds every score between them.
Pairs of nodes are walked from the roots, and a pair whose bound is below the weakest k-th score of the node's items is left, whole
batches at once; the rows of leaves that remain are scored exactly. The k-th scores begin with those of a part of
the documents, found the same way, and rise as a task goes on; only what can not be among the best is left unscored.

Items go through in groups of bounded size (``GROUP_TERMS`` item terms, one group for some tens of thousands of items), dealt by hash; one group
is on the driver and in the workers at a time, and a group costs one pass over the texts. A task returns at most ``top`` rows an item; these are merged in two steps, so no
task gets the rows of all tasks.

Defined results: a null text, and a text or an item without terms, has no rows and counts nowhere; rows that share an item id (null
included) are one item with the terms of all of them; equal documents are separate rows; ties go to the smaller doc_id, null ids last; a text of any
length is cut into terms piece by piece.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import written

#: Distinct terms of all items of a group.
GROUP_TERMS = 1 << 20
#: Distinct terms of the items that a chunk of documents meets at once.
BLOCK_TERMS = 1 << 13
#: Coordinates of a dense chunk of documents.
CHUNK = 1 << 22
#: Rows of a leaf of documents and of items.
DOC_LEAF, ITEM_LEAF = 16, 4
#: One document of so many is looked at first, to begin with a k-th score for most items.
FIRST_LOOK = 64
#: Parts that the rows of an item are merged in.
MERGES = 64
#: Bytes of a text that are cut into terms at once.
PIECE = 4 << 20

_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def count_terms(data: bytes) -> Counter:
    """Occurrences of each term."""
    counts: Counter = Counter()
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and _TERM[data[end]] != 0x20:
            end += 1
        counts.update(data[at:end].translate(_TERM).split())
        at = end
    return counts


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, times) of every item."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                counts = count_terms(text.as_py() or b"")
                at = pa.array(np.full(len(counts), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                                 names=["item", "term", "times"])

    return rows.mapInArrow(work, f"item {rows.schema['item'].dataType.simpleString()}, term binary, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def _narrow(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: all its terms, and how often it holds which of ``terms``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            ids, n, held, times, ends = [], [], [], [], [0]
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                counts = count_terms(text.as_py() or b"")
                if counts:
                    ids.append(i)
                    n.append(counts.total())
                    mine = sorted((place[t], k) for t, k in counts.items() if t in place)
                    held += [t for t, _ in mine]
                    times += [k for _, k in mine]
                    ends.append(len(held))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(held, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tf array<long>")


@dataclass
class Hierarchy:
    """Rows in order; nodes (first row, end, left, right; no child: -1), parents before children, with coordinate maxima."""

    order: np.ndarray
    nodes: np.ndarray
    maxima: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int) -> Hierarchy:
        held = rows > 0
        order, nodes = np.arange(len(rows)), [[0, len(rows), -1, -1]]
        for at in range(2 * len(rows)):
            if at == len(nodes):
                break
            lo, hi = nodes[at][:2]
            if hi - lo <= leaf:
                continue
            mine = held[order[lo:hi]]
            share = mine.sum(0)
            term = np.abs(share * 2 - (hi - lo)).argmin() if len(share) else 0
            if len(share) and 0 < share[term] < hi - lo:
                order[lo:hi] = order[lo:hi][np.argsort(~mine[:, term], kind="stable")]
                mid = lo + int(share[term])
            else:
                mid = (lo + hi) // 2
            nodes[at][2:] = len(nodes), len(nodes) + 1
            nodes += [[lo, mid, -1, -1], [mid, hi, -1, -1]]
        nodes = np.array(nodes)
        maxima = np.zeros((len(nodes), rows.shape[1]), rows.dtype)
        for at in range(len(nodes) - 1, -1, -1):
            lo, hi, left, right = nodes[at]
            maxima[at] = rows[order[lo:hi]].max(0) if left < 0 else np.maximum(maxima[left], maxima[right])
        return cls(order, nodes, maxima)


class Best:
    """The best rows of each item so far, and the score that a further one must reach."""

    def __init__(self, floors: np.ndarray, top: int):
        self.top, self.weakest, self.rows = top, np.maximum(floors, 1).astype(np.int64), [[] for _ in floors]

    def add(self, item: int, ids: list, scores: np.ndarray) -> None:
        rows = self.rows[item] + [(-int(s), i is None, i if i is not None else 0) for i, s in zip(ids, scores)]
        rows.sort()
        del rows[self.top:]
        self.rows[item] = rows
        if len(rows) == self.top:
            self.weakest[item] = max(self.weakest[item], -rows[-1][0])


def search_chunk(ids: list, x: np.ndarray, items: np.ndarray, q: np.ndarray, tree: Hierarchy, best: Best) -> int:
    """Bring ``best`` of ``items`` (numbers; ``q``: their rows) up to date with documents ``x``; returns how many products were taken."""
    docs = Hierarchy.build(x, DOC_LEAF)
    lo, hi, left, right = tree.nodes.T
    weakest = np.array([best.weakest[items[tree.order[a:b]]].min() for a, b in zip(lo, hi)])
    stack, scored = [(0, np.zeros(1, np.int64))], 0
    while stack:
        node, open_ = stack.pop()
        d_lo, d_hi, d_left, d_right = docs.nodes[node]
        while True:
            open_ = open_[tree.maxima[open_] @ docs.maxima[node] >= weakest[open_]]
            inner = left[open_] >= 0
            open_ = np.concatenate([open_[~inner], left[open_[inner]], right[open_[inner]]])
            # Both hierarchies go down one level together; at a leaf of documents the items go down to their leaves.
            if d_left >= 0 or not inner.any():
                break
        if not len(open_):
            continue
        if d_left >= 0:
            bounds = [(tree.maxima[open_] @ docs.maxima[c]).sum() for c in (d_left, d_right)]
            for c in ((d_left, d_right) if bounds[0] < bounds[1] else (d_right, d_left)):
                stack.append((c, open_))
            continue
        rows = docs.order[d_lo:d_hi]
        mine = np.concatenate([tree.order[lo[o]:hi[o]] for o in open_])
        scores = q[mine] @ x[rows].T
        scored += scores.size
        good = scores >= best.weakest[items[mine]][:, None]
        if not good.any():
            continue
        for i in np.flatnonzero(good.any(1)):
            best.add(items[mine[i]], [ids[r] for r in rows[good[i]]], scores[i][good[i]])
        for o in open_:
            weakest[o] = best.weakest[items[tree.order[lo[o]:hi[o]]]].min()
        for o in range(len(weakest) - 1, -1, -1):
            if left[o] >= 0:
                weakest[o] = min(weakest[left[o]], weakest[right[o]])
    return scored


@dataclass
class Group:
    """Items of one pass: ids, and (item, term, times) rows by item; corpus figures and term weights."""

    ids: list
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray
    weight: np.ndarray
    documents: int
    length: int
    floors: np.ndarray
    top: int

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, their terms, their rows) so that the terms of a block are bounded (or it is one item)."""
        starts = np.searchsorted(self.item, np.arange(len(self.ids) + 1))
        first = 0
        while first < len(self.ids):
            last = first + 1
            while last < len(self.ids) and starts[last + 1] - starts[first] <= BLOCK_TERMS:
                last += 1
            part = slice(starts[first], starts[last])
            terms, at = np.unique(self.term[part], return_inverse=True)
            values = self.weight[self.term[part]] * self.times[part]
            # Products of whole numbers in doubles are exact up to 2**53.
            q = np.zeros((last - first, len(terms)), np.float64 if values.sum() * 10**6 < 2**53 else np.int64)
            q[self.item[part] - first, at] = values
            yield np.arange(first, last), terms, q
            first = last


def _search(narrow: DataFrame, group: Group) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item, merged."""
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    shared = narrow.sparkSession.sparkContext.broadcast(group)

    def chunk(ids: list, batch: pa.RecordBatch, group: Group, blocks: list, best: Best) -> None:
        n, ends = batch.column("n").to_numpy(), batch.column("terms").offsets.to_numpy()
        term, tf = batch.column("terms").flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), np.diff(ends))
        m = 25 + 75 * n * group.documents // group.length
        value = 10**9 * tf // (1000 * tf + 8 * m[row])
        for items, terms, q, tree in blocks:
            at = np.searchsorted(terms, term).clip(max=len(terms) - 1)
            there = terms[at] == term
            rows, back = np.unique(row[there], return_inverse=True)
            most = max(DOC_LEAF, CHUNK // len(terms))
            for first in range(0, len(rows), most):
                part = (back >= first) & (back < first + most)
                x = np.zeros((min(most, len(rows) - first), len(terms)), q.dtype)
                x[back[part] - first, at[there][part]] = value[there][part]
                search_chunk([ids[r] for r in rows[first:first + most]], x, items, q, tree, best)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shared.value
        best = Best(group.floors, group.top)
        blocks = [(items, terms, q, Hierarchy.build(q, ITEM_LEAF)) for items, terms, q in group.blocks()]
        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            chunk(batch.column("doc_id").to_pylist(), batch, group, blocks, best)
        if id_kind is not None:
            found = [(i, None if none else key, -s) for i, rows in enumerate(best.rows) for s, none, key in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], id_kind),
                                              pa.array([f[2] for f in found], pa.int64())], names=["item", "doc_id", "score"])

    found = narrow.where(F.size("terms") > 0).mapInArrow(work, f"item int, doc_id {id_type}, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= group.top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= group.top)
    return found.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of highest score above 0 for every item."""
    spark = docs.sparkSession
    wanted = written(_item_terms(items, item_id, item_text), "rank-items")
    item_type, doc_type = wanted.schema["item"].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()
    groups = -(-wanted.count() // GROUP_TERMS)
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    for g in range(groups):
        mine = wanted.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).toArrow()  # GROUP_TERMS rows
        if not len(mine):
            continue
        ids = mine.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        coded = mine.column("term").combine_chunks().dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        terms = coded.dictionary.to_pylist()
        item, term, times = ids.indices.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), mine.column("times").to_numpy()
        by_item = np.lexsort((term, item))
        narrow = written(_narrow(docs, terms, doc_id, doc_text), f"rank-narrow-{g}")
        n, length = narrow.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for r in narrow.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per item term
            df[r["term"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        names = ids.dictionary.to_pylist()
        group = Group(names, item[by_item], term[by_item], times[by_item], weight, n, length, np.zeros(len(names), np.int64), top)
        look = _search(narrow.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_LOOK)) == 0), group)
        for r in look.where(F.col("rank") == top).collect():  # a row per item
            group.floors[r["item"]] = r["score"]
        found = written(_search(narrow, group), f"rank-found-{g}")
        named = spark.createDataFrame(pa.table({"number": pa.array(range(len(names)), pa.int32()), "item_id": ids.dictionary}))
        out = out.unionByName(found.join(F.broadcast(named), F.col("item") == F.col("number")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
