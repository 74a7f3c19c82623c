"""Vector code compression: product codes by dual-tree Lloyd rounds, in whole numbers.

Components become ``floor(SCALE * x)``, a vector is cut into equal consecutive parts, and each part position has a codebook of a
few entries. A round gives every part its nearest entry and moves each entry to the floored mean of its parts.

Vectors are kept as blocks of bounded size, written once. A block holds, for each part position, a tree over its parts (halved along
the widest side, down to ``LEAF`` parts) with each node's box, count and sum. A round walks that tree and a tree over the
entries together. Of a pair of nodes the boxes bound the distance from both sides: entries that lie farther than the
worst case of others are pruned, and so are single entries that lose to another one in the whole box. A node with
one entry left is assigned by its cached sum, without a look at its parts; only parts of leaves that stay
uncertain are measured, in 64-bit integers. All bounds are whole numbers too, and pruning asks for strictly less, so ties
and sums are exact. A task adds up its blocks, and a round moves one row a task, entry and component.

Defined results: rows whose vector is null or holds null or non-finite components are left out; a vector shorter than the longest
one (rounded up to whole parts) is continued with zeros; whole components beyond what lets distances of that width
fit 64 bits (23,000 before scaling at 64 components) are cut to that bound; of rows that share an id the least vector starts an entry, and all are encoded;
a null id comes last; with fewer ids than entries there are fewer entries; an empty table gives no codes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sized, written

#: Whole steps of one unit.
SCALE = 4096
#: Parts of a leaf, at least.
LEAF = 8
#: Components of a block.
BLOCK = 1 << 18


@dataclass
class Books:
    """A codebook for each part position: (parts, entries, width) whole numbers, and the vectors' blocks."""

    entries: np.ndarray
    blocks: DataFrame

    def text(self) -> str:
        """All components in decimal, by part, entry and place, with commas."""
        return ",".join(map(str, self.entries.ravel().tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def bound(width: int) -> int:
    """Largest whole component for which all squared distances of ``width`` components fit 64 bits."""
    return math.isqrt(2**61 // max(width, 1)) // 2


def whole(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, continued with zeros to ``width``."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < size[:, None]] = np.clip(np.floor(values * SCALE), -bound(width), bound(width)).astype(np.int64)
    return out


def _cuts(n: int, level: int) -> np.ndarray:
    return np.arange((1 << level) + 1) * n >> level


def tree_order(points: np.ndarray, depth: int) -> np.ndarray:
    """Rows in the order of a tree that halves every node along its widest side, ``depth`` times."""
    n = len(points)
    order = np.arange(n)
    for level in range(depth):
        cuts = _cuts(n, level)
        here = points[order]
        side = np.maximum.reduceat(here, cuts[:-1]) - np.minimum.reduceat(here, cuts[:-1])
        node = np.repeat(np.arange(1 << level), np.diff(cuts))
        order = order[np.lexsort((here[np.arange(n), side.argmax(1)[node]], node))]
    return order


def _upwards(leaves: np.ndarray, join) -> np.ndarray:
    """Nodes of all levels, root first, from those of the lowest one."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(join(levels[-1][0::2], levels[-1][1::2]))
    return np.concatenate(levels[::-1])


@dataclass
class Tree:
    """Parts in tree order; box and sum of every node, root first."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    depth: int

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        depth = max(0, (len(points) // LEAF).bit_length() - 1)
        order = tree_order(points, depth)
        points = points[order]
        cuts = _cuts(len(points), depth)[:-1]
        return cls(points, _upwards(np.minimum.reduceat(points, cuts), np.minimum), _upwards(np.maximum.reduceat(points, cuts), np.maximum),
                   _upwards(np.add.reduceat(points, cuts), np.add), depth), order


def _entry_levels(entries: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Entries in tree order, and per level (low, high, whether there is any) of its nodes."""
    depth = (len(entries) - 1).bit_length()
    order = np.arange(len(entries))
    levels = []
    for level in range(depth + 1):
        cuts = _cuts(len(entries), level)
        boxes = [entries[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]
        levels.append((np.array([b.min(0) if len(b) else entries[0] for b in boxes]), np.array([b.max(0) if len(b) else entries[0] for b in boxes]),
                       np.array([len(b) > 0 for b in boxes])))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                own = order[a:b]
                side = (entries[own].max(0) - entries[own].min(0)).argmax()
                order[a:b] = own[np.argsort(entries[own, side], kind="stable")]
    return order, levels


def walk(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries: (entry of every point in tree order, points per entry, their sums, points that were measured)."""
    n, width = tree.points.shape
    order, levels = _entry_levels(entries)
    squares = (entries**2).sum(1)
    chosen = np.full(n, -1, np.int64)
    counts, sums = np.zeros(len(entries), np.int64), np.zeros((len(entries), width), np.int64)
    active, alive = np.zeros(1, np.int64), np.ones((1, 1), bool)
    measured = []
    for level in range(tree.depth + 1):
        last = level == tree.depth
        at = (1 << level) - 1 + active
        low, high = tree.low[at][:, None], tree.high[at][:, None]
        step = min(level + 1, len(levels) - 1)
        if alive.shape[1] < 1 << step:
            alive = np.repeat(alive, 2, axis=1)
        e_low, e_high, there = levels[step]
        alive = alive & there
        least = (np.maximum(0, np.maximum(e_low - high, low - e_high)) ** 2).sum(2)
        most = (np.maximum(np.abs(e_high - low), np.abs(high - e_low)) ** 2).sum(2)
        alive &= least <= np.where(alive, most, np.iinfo(np.int64).max).min(1)[:, None]
        if step == len(levels) - 1:
            # Single entries: one that loses to the entry nearest to the middle, wherever a point lies in the box.
            single = order[_cuts(len(entries), step)[:-1].clip(max=len(entries) - 1)]
            twice = ((low + high - 2 * entries[single]) ** 2).sum(2)  # four times the squared distance to the middle
            best = single[np.where(alive, twice, np.iinfo(np.int64).max).argmin(1)]
            slope = 2 * (entries[single] - entries[best][:, None])
            worst = np.where(slope > 0, slope * high, slope * low).sum(2) + squares[best][:, None] - squares[single]
            alive &= worst >= 0
            sure = alive.sum(1) == 1
            winner = single[alive[sure].argmax(1)]
            cuts = _cuts(n, level)
            for node, entry in zip(active[sure], winner):
                chosen[cuts[node]:cuts[node + 1]] = entry
            np.add.at(counts, winner, np.diff(cuts)[active[sure]])
            np.add.at(sums, winner, tree.sums[at[sure]])
            active, alive = active[~sure], alive[~sure]
        if last and len(active):
            cuts = _cuts(n, level)
            size = np.diff(cuts)[active]
            points = np.repeat(cuts[active] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            spread = _cuts(len(entries), step)
            candidate = np.zeros((len(active), len(entries)), bool)
            for node in range(alive.shape[1]):
                candidate[:, order[spread[node]:spread[node + 1]]] = alive[:, node, None]
            far = ((tree.points[points][:, None] - entries) ** 2).sum(2)
            entry = np.where(np.repeat(candidate, size, axis=0), far, np.iinfo(np.int64).max).argmin(1)
            chosen[points] = entry
            np.add.at(counts, entry, 1)
            np.add.at(sums, entry, tree.points[points])
            measured.append(points)
        active = np.repeat(2 * active, 2) + np.tile([0, 1], len(active))
        alive = np.repeat(alive, 2, axis=0)
    return chosen, counts, sums, np.concatenate(measured) if measured else np.zeros(0, np.int64)


def _blocks(kept: DataFrame, width: int, parts: int) -> DataFrame:
    """Blocks of vectors: ids, labels, and per part position a tree as bytes."""
    rows = max(LEAF, BLOCK // max(width, 1))

    def packed(ids: pa.Array, labels: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        built = [Tree.build(p) for p in np.split(points, parts, axis=1)]
        flat = lambda values: pa.array([np.concatenate([v.ravel() for v in values]).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([labels.to_pylist()], pa.list_(labels.type)),
             flat([t.points.astype(np.int32) for t, _ in built]), flat([o.astype(np.int32) for _, o in built]), flat([t.low.astype(np.int32) for t, _ in built]),
             flat([t.high.astype(np.int32) for t, _ in built]), flat([t.sums for t, _ in built])],
            names=["ids", "labels", "points", "places", "low", "high", "sums"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                take = min(rows - n, len(batch) - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == rows:
                    yield pack(held)
                    held, n = [], 0
        if held:
            yield pack(held)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels, vectors = (table.column(i).chunk(0) for i in range(3))
        return packed(ids, labels, whole(vectors, width))

    types = [kept.schema[c].dataType.simpleString() for c in ("id", "label")]
    return kept.select("id", "label", "vector").mapInArrow(
        work, f"ids array<{types[0]}>, labels array<{types[1]}>, points binary, places binary, low binary, high binary, sums binary")


def _trees(batch: pa.RecordBatch, i: int, width: int, parts: int) -> list[tuple[Tree, np.ndarray]]:
    """The trees of one block, and the vector that each point belongs to."""
    read = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
    n, w = len(batch.column("ids")[i]), width // parts
    depth = max(0, (n // LEAF).bit_length() - 1)
    shape = (parts, (2 << depth) - 1, w)
    points = read("points", np.int32).reshape(parts, n, w).astype(np.int64)
    places = read("places", np.int32).reshape(parts, n)
    low, high = (read(c, np.int32).reshape(shape).astype(np.int64) for c in ("low", "high"))
    sums = read("sums", np.int64).reshape(shape)
    return [(Tree(points[p], low[p], high[p], sums[p], depth), places[p]) for p in range(parts)]


def _first_vectors(kept: DataFrame, n: int) -> list:
    """The least vector of each of the ``n`` smallest ids, in their order; at most ``n`` rounds of ``n`` rows."""
    found: dict = {}
    rest = kept
    while len(found) < n:
        rows = rest.orderBy(F.col("id").asc_nulls_last(), "vector").limit(n).collect()
        for r in rows:
            found.setdefault(r.id, r.vector)
        if len(rows) < n or rows[-1].id is None:
            break
        rest = kept.where((F.col("id") > F.lit(rows[-1].id)) | F.col("id").isNull())
    return list(found.values())[:n]


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16,
        rounds: int = 6) -> Books:
    """Codebooks of the whole table after ``rounds`` rounds."""
    kept = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vector")).where(finite(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts) * parts
    w = width // parts
    blocks = written(_blocks(kept, width, parts), "code-blocks")
    first = _first_vectors(kept, entries)
    books = whole(pa.array(first, pa.list_(pa.float64())), width).reshape(len(first), parts, w).swapaxes(0, 1)
    for _ in range(rounds if w else 0):
        sums = {(r.part, r.entry, r.place): (r.n, int(r.total)) for r in _totals(blocks, books, width, parts).collect()}  # a row per component of the books
        books = np.array([[[sums[p, e, k][1] // sums[p, e, k][0] if (p, e, k) in sums else int(books[p, e, k]) for k in range(w)]
                           for e in range(books.shape[1])] for p in range(parts)], np.int64).reshape(books.shape)
    return Books(books, blocks)


def _totals(blocks: DataFrame, books: np.ndarray, width: int, parts: int) -> DataFrame:
    """(part, entry, place, n, total) of the parts nearest to each entry in use."""
    k, w = books.shape[1], width // parts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, w), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                for p, (tree, _) in enumerate(_trees(batch, i, width, parts)):
                    _, c, s, _ = walk(tree, books[p])
                    counts[p] += c
                    sums[p] += s
        p, e, place = (x.ravel() for x in np.indices((parts, k, w), np.int32))
        n = np.repeat(counts.ravel(), w)
        used = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (p, e, place, n, sums.ravel())], names=["part", "entry", "place", "n", "total"])

    local = blocks.mapInArrow(work, "part int, entry int, place int, n long, total long")
    return local.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def encode(books: Books) -> DataFrame:
    """(id, label, codes, error) of every vector that the books were fitted on: one byte a part, squared distance in all."""
    entries, blocks = books.entries, books.blocks
    parts, _, w = entries.shape
    types = [blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n = len(batch.column("ids")[i])
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, (tree, places) in enumerate(_trees(batch, i, w * parts, parts) if w else ()):
                    chosen = walk(tree, entries[p])[0]
                    codes[places, p] = chosen
                    error[places] += ((tree.points - entries[p][chosen]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values,
                                                  pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["id", "label", "codes", "error"])

    return blocks.mapInArrow(work, f"id {types[0]}, label {types[1]}, codes binary, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16,
             rounds: int = 6) -> DataFrame:
    """vec_id, label, code (hex), error, label_error (summed over equal labels) and the digest of the codebooks."""
    books = fit(df, id_col, vec_col, label_col, parts, entries, rounds)
    coded = written(encode(books), "code-rows")
    per = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "code-labels")
    return coded.join(sized(per), F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "label", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
