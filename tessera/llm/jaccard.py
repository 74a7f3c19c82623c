"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets are
one node. Two nodes link when ``100 * intersection >= percent * union``.

Light sets (up to a boundary size) enumerate the subsets of the sizes that an intersection with a
partner must reach: partners share such a subset. Heavy sets are posted under their elements in
inverted lists, and the lists are scanned. The boundary is the one of least cost: subsets to enumerate
against list entries to post and to scan, measured on the input. Light sets that can have a
partner beyond the boundary do both.

Lists are kept short in two exact steps. Elements are ordered by how many nodes hold them, rare
ones first, and only a prefix is posted: partners share one of it. And a large set is posted by its
``sketch``, its elements of smallest hash: for a linked pair each of the smallest hashes of the union is
common with a chance of at least the threshold, so the sketches share at least ``least_common`` of them but for
a chance below 1e-12 a pair - a chance of the order of a 64-bit hash collision, and the only one taken.

Lists of up to ``SHORT`` members are compared pair by pair, which is linear in their entries. No longer list becomes a table of
pairs: each has a centre (the member whose elements are the most common ones), and the members of all lists of one centre are a group,
once each, so the many lists of one family of copies meet once. A group's whole sets go to one task, in blocks if it is large, which compares them in memory and returns
no more links than bring its members together (``overlaps``): what is written grows with the members, not with their pairs.

Only where even these comparisons are more work than a round over tables, rounds come before. In a round each long list's members are
measured against the centre, and what links becomes one component. A member
that does not link to its centre can link to another member only by what it does not share with the
centre: near members (distance up to ``NEAR``) are posted again under the elements that they or the centre have alone, in short
new lists; others (beyond ``NEAR`` less a link distance, by the triangle inequality) stay in their list for another centre. A linked pair is
together in one of the two. Lists of one component are done, and what is left after the last round is compared as above.
Links are counted on whole sets; a link between different texts is never lost.

Defined results: a null, empty or blank text has an empty set and links with nothing; a text of fewer words
than a shingle has one shingle; equal rows and rows that share an id are nodes by their text; a null id
is no component id unless all of a component are null. Other columns are passed through by ``keep_one``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.arrow import pieces
from tessera.llm.common import discard, settled, sized, written
from tessera.llm.hashing import GOLDEN, mix, span_hashes
from tessera.llm.overlaps import spanning_links

#: Largest chance that a linked pair is not posted together.
MISS = 1e-12
#: Elements of a sketch by threshold: more where sets may differ more.
SKETCH = {90: 64, 80: 96}
#: Set sizes that the cost is measured for at first; more, as long as the least cost is at the end of them.
LIGHT_MOST = 20
#: Rounds of lists before the remaining pairs are compared, if these are not few enough before.
ROUNDS = 5
#: Members of a list up to which all its pairs are compared at once.
SHORT = 8
#: Pairs in longer lists for each node that cost less than another round.
PAIRS_PER_NODE = 2
#: Pairs that are compared in memory at the cost of one that goes through tables.
IN_MEMORY = 10_000
#: Members of a group and elements of their sets in one block: a task holds two.
BLOCK_ROWS, BLOCK_ELEMENTS = 2048, 1 << 20
#: Largest distance of a near member. Far ones begin more than a link distance below it.
NEAR = 0.45
#: Rows of narrow tables between steps for each file, and the least number of files: many shuffle partitions make no more of them.
FILE_ROWS, LEAST_FILES = 25_000, 8
#: Rows of the table of frequent elements.
FREQUENT_ROWS = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, sorted by text and then hash (unsigned)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    blank = _SPACE[low]
    first = np.zeros(len(low) + 1, bool)
    first[starts] = True
    begin = np.flatnonzero(~blank & (np.r_[True, blank[:-1]] | first[:-1]))
    end = np.flatnonzero(~blank & (np.r_[blank[1:], True] | first[1:])) + 1
    if not len(begin):
        return none
    word = span_hashes(low, begin, end)
    row = np.searchsorted(starts, begin, side="right") - 1
    n = len(word)
    left = np.searchsorted(row, row, side="right") - np.arange(n)  # words from here to the text's end
    from_start = np.arange(n) - np.searchsorted(row, row, side="left")
    size = np.minimum(left + from_start, k)
    keep = np.flatnonzero((left >= k) | (from_start == 0) & (left < k))
    out = size[keep].astype(np.uint64)
    for j in range(k):
        there = keep + j
        use = j < size[keep]
        out = np.where(use, mix(out * GOLDEN + word[np.minimum(there, n - 1)]), out)
    row = row[keep]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    fresh = np.r_[True, (row[1:] != row[:-1]) | (out[1:] != out[:-1])]
    return row[fresh], out[fresh]


def least_common(size: int, similarity: float) -> int:
    """Elements that two sketches of ``size`` share, but for a chance of MISS, if the sets are so similar."""
    tail, least = 0.0, 0
    while least < size:
        tail += math.comb(size, least) * similarity**least * (1 - similarity) ** (size - least)
        if tail > MISS:
            break
        least += 1
    return least


@cache
def sketch_plan(percent: int) -> tuple[int, int]:
    """(elements of a sketch, least number that sketches of a linked pair share)."""
    size = SKETCH.get(percent) or (64 if percent >= 90 else 128 if percent < 80 else 96)
    return size, max(1, least_common(size, percent / 100))


def prefix_length(n: int, percent: int) -> int:
    """Elements that a set of ``n`` posts, in rare-first order."""
    size, least = sketch_plan(percent)
    if n * 100 <= percent * size:  # all partners are whole in their sketches
        return n - -(-percent * n // 100) + 1
    return min(n, size) - min(least, -(-percent * n // 100)) + 1


@cache
def subset_sizes(n: int, percent: int) -> tuple[int, ...]:
    """Sizes that the intersection of a linked pair must reach, over all partner sizes of ``n``."""
    lo, hi = -(-percent * n // 100), 100 * n // percent
    return tuple(sorted({-(-percent * (n + m) // (100 + percent)) for m in range(lo, hi + 1)}))


@cache
def subset_count(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent) if c <= n)


def boundary(sizes: list[tuple[int, int, int]], percent: int, most: int = LIGHT_MOST) -> int:
    """The light-heavy boundary of least cost up to ``most``; ``sizes``: (set size, nodes, list entries they scan)."""
    best, best_cost = 0, None
    for x in range(most + 1):
        cost = 0
        for n, nodes, scanned in sizes:
            if n <= x:
                cost += nodes * subset_count(n, percent)
            if n > x or 100 * n // percent > x:
                cost += nodes * prefix_length(n, percent) + scanned
        if best_cost is None or cost < best_cost:
            best, best_cost = x, cost
    return best


def _sets(docs: DataFrame, k: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, text_key, node, n and the sketch (or the whole set) of each text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = sketch_plan(percent)[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in pieces(batch.column(2)):
                row, key = shingle_sets(data, starts, k)
                n = np.bincount(row, minlength=last - first)[:last - first] if len(row) else np.zeros(last - first, np.int64)
                bound = np.r_[0, np.cumsum(n)]
                total = np.zeros(len(key) + 1, np.uint64)
                np.cumsum(mix(key + GOLDEN), out=total[1:])
                node = mix(total[bound[1:]] - total[bound[:-1]] + n.astype(np.uint64)).view(np.int64)
                take = n
                if not whole:
                    take = np.minimum(n, size)
                    key = key[np.arange(len(key)) - bound[row] < size]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)].astype(np.int32)), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                                                  pa.array(node), pa.array(n), lists], names=["doc_id", "text_key", "node", "n", "keys"])

    return docs.mapInArrow(work, f"doc_id {id_type}, text_key long, node long, n long, keys array<long>")


def _frequent(keys: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys, at most FREQUENT_ROWS of them, sorted, with their counts."""
    steps = {r["p"]: r["k"] for r in keys.groupBy(F.floor(F.log2("f")).alias("p")).agg(F.count("*").alias("k")).collect()}  # a row per power of two
    power, rows = (max(steps) + 1 if steps else 1), 0
    while power > 1 and rows + steps.get(power - 1, 0) <= FREQUENT_ROWS:
        power -= 1
        rows += steps.get(power, 0)
    table = keys.where(F.col("f") >= (1 << power)).select("key", "f").toArrow()
    key, f = table.column("key").to_numpy(), table.column("f").to_numpy()
    order = np.argsort(key)
    return key[order], f[order]


def _subset_keys(keys: np.ndarray, percent: int) -> np.ndarray:
    out = []
    for c in subset_sizes(len(keys), percent):
        if c <= len(keys):
            mixed = mix(keys.view(np.uint64) ^ np.uint64(c))
            for drop in itertools.combinations(range(len(keys)), len(keys) - c):
                left = np.delete(mixed, drop) if drop else mixed
                out.append(mix(np.array([left.sum(dtype=np.uint64) + np.uint64(c)]))[0])
    return np.unique(np.array(out, np.uint64)).view(np.int64)


def _postings(nodes: DataFrame, percent: int, x: int, frequent) -> DataFrame:
    """(key, node, n, weight): subset keys of light sets, prefix elements of heavy ones; how common its elements are."""
    spark = nodes.sparkSession
    shared = spark.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = shared.value
        for batch in batches:
            keys, owners, counts, weights = [], [], [], []
            for node, n, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = np.asarray(sketch.values)
                f = np.zeros(len(own), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                    f = np.where(hot[at] == own, often[at], 0)
                if n <= x:
                    keys.append(_subset_keys(own, percent))
                if n > x or 100 * n // percent > x:
                    mine = own[np.lexsort((own, f))][:prefix_length(n, percent)]
                    keys.append(np.concatenate([keys.pop(), mine]) if n <= x else mine)
                owners.append(np.full(len(keys[-1]), node))
                counts.append(np.full(len(keys[-1]), n))
                weights.append(np.full(len(keys[-1]), np.log2(1 + f).sum() / len(own)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(owners).astype(np.int64)),
                                                  pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(weights))], names=["key", "node", "n", "weight"])

    return nodes.select("node", "n", "keys").mapInArrow(work, "key long, node long, n long, weight double")


def _files(rows: int) -> int:
    return max(LEAST_FILES, math.ceil(rows / FILE_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of ``edges`` (a, b).

    Minimum labels travel along the edges, and each label is replaced by its own label, so long
    chains halve; a round is written, and the rounds end when no label changes.
    """
    files = _files(2 * edges.count())
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().coalesce(files), "cc-edges")
    held = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.col("node").alias("old"), F.least("node", "m").alias("label")).coalesce(files), "cc-labels")
    while True:
        labels = sized(held.select("node", "label"))
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.lit(None).cast("long").alias("old"), "label")
        step = near.unionByName(held.select("node", F.col("label").alias("old"), "label")).groupBy("node").agg(F.max("old").alias("old"), F.min("label").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("far"))
        fresh = written(step.join(jump, "best", "left").select("node", "old", F.least("best", "far").alias("label")).coalesce(files), "cc-labels")
        discard(held)
        held = fresh
        if not fresh.where("old != label").limit(1).count():
            discard(both)
            return fresh.select("node", "label")


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``lists`` with the components known by now."""
    return lists.drop("comp").join(sized(labels).withColumnRenamed("label", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _whole(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, keys): the whole sets of the ``wanted`` nodes, from one text each; and the written table that they are made from."""
    keep = nodes.join(wanted, "node", "left_semi").select(F.col("from.doc_id").alias("k_id"), F.col("from.text_key").alias("k_key"))
    keep = written(keep.join(repeated, (F.col("k_key") == F.col("r_key")) & F.col("k_id").eqNullSafe(F.col("r_id")), "left").select(
        "k_id", "k_key", F.col("r_key").isNotNull().alias("many")), "jaccard-wanted")
    texts = docs.join(sized(keep), (F.col("text_key") == F.col("k_key")) & F.col("doc_id").eqNullSafe(F.col("k_id")))
    texts = texts.where("NOT many").unionByName(texts.where("many").dropDuplicates(["doc_id", "text_key"])).select("doc_id", "text_key", "text")
    return _sets(texts, k, percent, True).select("node", "keys"), keep


def _grouped_links(lists: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that bring together what the links among the members of each list bring together; lists of one center are one group."""
    members = written(lists.select("center", "node", "n", "comp").dropDuplicates(["center", "node"]), "jaccard-members")
    groups = members.groupBy("center").agg(F.count("*").alias("members"), F.sum("n").alias("elements"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_ROWS, F.col("elements") / BLOCK_ELEMENTS))
    groups = written(groups.select("center", blocks.alias("blocks")), "jaccard-blocks")
    dealt = members.join(sized(groups), "center").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    whole, keep = _whole(members.select("node").distinct(), nodes, docs, repeated, k, percent)
    # A task for each two blocks of a group, and for each block by itself.
    each = dealt.join(whole, "node").select("center", "node", "comp", "block", "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    each = each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")

    def work(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, comp, block, keys = (group.column(c).combine_chunks() for c in ("node", "comp", "block", "keys"))
        a, b = spanning_links(keys.flatten().to_numpy(), keys.value_lengths().to_numpy().astype(np.int64), comp.to_numpy(), block.to_numpy(), percent)
        node = node.to_numpy()
        return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    found = settled(each.groupBy("center", "i", "j").applyInArrow(work, "a long, b long").distinct(), "jaccard-grouped")
    discard(members, groups, keep)
    return found


def _measured(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b, n_a, n_b, wide) that may be linked, or near if they are ``wide``, on whole sets: common, total (of the union), linked, delta.

    ``delta`` (of wide ones): the elements that one of the two has alone. Sketches cut to 31 bits are compared first, and only what
    is left brings its whole sets, of one text a node: the sets go through one shuffle by node, and each pair carries one of its two.
    """
    size = sketch_plan(percent)[0]

    def sides(left: DataFrame, table: DataFrame) -> DataFrame:
        for s in ("a", "b"):
            left = left.join(table.select(*[F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in table.columns]), s)
        return left

    # Two common elements of a sketch that agree in 31 bits count once: one less is asked for, and two such coincidences are rarer than MISS.
    high = F.greatest("n_a", "n_b")
    least = F.when(F.col("wide"), F.least(F.lit(least_common(size, 1 - NEAR)), F.floor(high * (1 - NEAR)))).otherwise(
        F.least(F.lit(least_common(size, percent / 100)), F.floor(high * (percent / 100))))
    near = sides(pairs, nodes.select("node", F.transform("keys", lambda x: x.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("keys")))
    near = settled(near.where(F.size(F.array_intersect("keys_a", "keys_b")) >= least - 1).select(*pairs.columns), "jaccard-near")
    whole, keep = _whole(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, repeated, k, percent)
    full = sides(near, whole)
    full = full.withColumn("common", F.size(F.array_intersect("keys_a", "keys_b")))
    full = full.withColumn("total", F.col("n_a") + F.col("n_b") - F.col("common"))
    linked = F.col("common") * 100 >= F.col("total") * percent
    delta = F.when(F.col("wide") & (F.col("common") >= (1 - NEAR) * F.col("total") - 1),
                   F.concat(F.array_except("keys_a", "keys_b"), F.array_except("keys_b", "keys_a")))
    out = settled(full.select(*pairs.columns, "common", "total", linked.alias("linked"), delta.alias("delta")), "jaccard-measured")
    discard(near, keep)
    return out


def _next_lists(lists: DataFrame, measured: DataFrame, percent: int, files: int) -> DataFrame:
    """Lists (key, node, n, comp, weight, center) still of several components -> the next round's.

    With D the elements that a member or the centre has alone, two members differ by
    ``|D_u| + |D_v| - 2 |common|``, so a member that failed to link shares a known part of D with each partner: a
    prefix of D, rare elements first, shares one. A partner's D is smaller by what linked pairs may differ by at most, so the prefix
    is no longer than that, and a member with as many elements of its own has none. Members that may share nothing (loose ones) post
    all of D, for partners that must share some, and stay in their list for each other. Only the prefixes carry elements: lists,
    sizes of D and components meet without them.
    """
    delta = 1 - percent / 100
    gap = 1 - F.col("common") / F.col("total")
    sides = [measured.where("wide").select(F.col(c).alias("center"), F.col(m).alias("node"), gap.alias("gap"), "linked", F.size("delta").alias("d"), "delta") for c, m in ("ab", "ba")]
    of_center = sides[0].unionByName(sides[1])
    placed = written(lists.where("node != center").join(of_center.drop("delta"), ["center", "node"], "left").coalesce(files), "jaccard-placed")
    # Most elements that a linked partner of the member may differ by, whatever the partner's size.
    most = F.floor(F.col("n") * (100 - percent) / percent)
    near = placed.where(F.col("gap") <= NEAR).dropDuplicates(["center", "node"]).select("center", "node", "n", "comp", "weight", "linked", most.alias("most"), "d")
    # Without a member that failed to link, the centre has brought all its near members together.
    least = near.groupBy("center").agg(F.min("d").alias("d_any"), F.min(F.when(~F.col("linked"), F.col("d"))).alias("d_open")).where("d_open IS NOT NULL")
    # A linked member has to meet those only that failed.
    partner = F.greatest(F.when(F.col("linked"), F.col("d_open")).otherwise(F.col("d_any")), F.col("d") - F.col("most"))
    need = F.ceil((F.col("d") + partner - F.col("most")) / 2)
    near = written(near.join(sized(written(least.coalesce(files), "jaccard-centers")), "center").withColumn("need", need).where("need <= d").coalesce(files), "jaccard-needs")
    # So close to the bound that nothing need be shared: two such members, one of them not linked, may share nothing, so
    # these stay in their list as well where it holds a partner for them. All others share an element of D with every partner.
    loose = placed.select("key", "center", "node").join(near.where("need < 1").select("center", "node", "linked", "d", "most"), ["center", "node"])
    of_list = loose.groupBy("key").agg(F.min("d").alias("k_any"), F.min(F.when(~F.col("linked"), F.col("d"))).alias("k_open")).where("k_open IS NOT NULL")
    loose = loose.join(of_list, "key").where(F.col("d") + F.when(F.col("linked"), F.col("k_open")).otherwise(F.col("k_any")) <= F.col("most"))
    loose = loose.select("key", "node", F.lit(True).alias("loose"))
    far = placed.join(loose, ["key", "node"], "left").where(F.col("gap").isNull() | (F.col("gap") > NEAR - 1.05 * delta) | F.col("loose")).select("key", "node", "n", "comp", "weight")
    prefix = F.col("d") - F.greatest("need", F.lit(1)) + 1
    each = near.join(of_center.select("center", "node", "delta"), ["center", "node"]).select("center", "node", prefix.alias("prefix"), F.explode("delta").alias("element"))
    # An element of one member alone takes a place in its prefix and makes no list.
    often = each.groupBy("center", "element").agg(F.count("*").alias("f"))
    order = Window.partitionBy("center", "node").orderBy("f", "element")
    first = each.join(often, ["center", "element"]).withColumn("place", F.row_number().over(order)).where("place <= prefix AND f > 1").select("center", "node", "element")
    posted = written(first.join(near.select("center", "node", "n", "comp", "weight", "linked"), ["center", "node"]).select(
        F.xxhash64("center", "element").alias("key"), "node", "n", "comp", "weight", "linked").coalesce(files), "jaccard-posted")
    useful = posted.groupBy("key").agg(F.min("linked").alias("all_linked"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("NOT all_linked AND lo < hi").select("key")
    out = settled(far.unionByName(posted.join(useful, "key", "left_semi").drop("linked")).dropDuplicates(["key", "node"]).coalesce(files), "jaccard-next")
    discard(placed, near, posted)
    return out


def similar_groups(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text_key, n_shingles, component_id (smallest id reachable by links), group.

    ``group`` is a key of the component (two components have one id if texts share it); null without words.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    sketched = written(_sets(rows, k, percent, False), "jaccard-sketches")
    nodes = settled(sketched.where("n > 0").groupBy("node").agg(
        F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.min("doc_id").alias("least"),
        F.min(F.struct("doc_id", "text_key")).alias("from")), "jaccard-nodes")
    sets = written(sketched.drop("keys"), "jaccard-rows")
    discard(sketched)
    repeated = written(sets.groupBy(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key")).agg(F.count("*").alias("rows")).where("rows > 1").drop("rows"), "jaccard-repeated")
    keys = written(nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("f")).where("f > 1"), "jaccard-keys")
    most = LIGHT_MOST
    while True:
        # What a set scans: the lists of its prefix, its rarest elements.
        light = nodes.where(F.col("n") <= most).select("node", "n", F.explode("keys").alias("key")).join(keys, "key", "left")
        prefix = F.element_at(F.array(*[F.lit(prefix_length(n, percent)) for n in range(1, most + 1)]), F.col("n").cast("int"))
        light = light.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.coalesce("f", F.lit(1)))).alias("f"))  # of one set of up to ``most`` elements
        scanned = F.aggregate(F.slice("f", F.lit(1), prefix), F.lit(0).cast("long"), lambda a, f: a + f)
        sizes = light.groupBy("n").agg(F.count("*").alias("nodes"), F.sum(scanned).alias("scanned")).collect()  # a row per size up to ``most``
        x = boundary([tuple(r) for r in sizes], percent, most)
        if x < most or not any(r["n"] == most for r in sizes):
            break
        most += LIGHT_MOST

    held = settled(_postings(nodes, percent, x, _frequent(keys)), "jaccard-postings")
    discard(keys)
    lists, links, labels = held.withColumn("comp", F.col("node")), None, None
    few = PAIRS_PER_NODE * nodes.count()
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")

    def pairs_of(mine: DataFrame, all_lists: DataFrame) -> DataFrame:
        other = all_lists.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
        pairs = mine.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), "comp").join(other, "key").where("a < b AND comp != comp_b")
        return pairs.where(low * 100 >= high * percent).select("a", "b", "n_a", "n_b", F.lit(False).alias("wide"))

    for turn in range(ROUNDS + 1):
        mixed = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("weight", "node", "n")).alias("c"), F.count("*").alias("members")).where("lo < hi")
        lists = settled(lists.join(mixed.select("key", F.col("c.node").alias("center"), F.col("c.n").alias("n_center"), "members"), "key"), "jaccard-lists")
        discard(held)
        held = lists
        short = F.col("members") <= SHORT
        counted = lists.agg(F.count("*"), F.sum(F.when(~short, (F.col("members") - 1) / 2)).alias("long")).first()
        if not counted[0]:
            break
        last = turn == ROUNDS or (counted["long"] or 0) / IN_MEMORY <= few
        # All pairs of short lists, and before the last round the members of long ones with their centre.
        pairs = pairs_of(lists.where(short), lists.where(short))
        if not last:
            a_is_center = F.col("center") < F.col("node")
            rays = lists.where(~short & (F.col("node") != F.col("center"))).select(
                F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"), F.when(a_is_center, F.col("n_center")).otherwise(F.col("n")).alias("n_a"),
                F.when(a_is_center, F.col("n")).otherwise(F.col("n_center")).alias("n_b"), F.lit(True).alias("wide"))
            pairs = pairs.unionByName(rays.where(low >= F.floor(high * (1 - NEAR))))
        pairs = written(pairs.groupBy("a", "b", "n_a", "n_b").agg(F.max("wide").alias("wide")).coalesce(_files(counted[0])), "jaccard-pairs")
        measured = _measured(pairs, nodes, rows, repeated, k, percent)
        discard(pairs)
        found = written(measured.where("linked").select("a", "b").coalesce(_files(counted[0])), "jaccard-links")
        links = found if links is None else links.unionByName(found)
        if last:
            discard(measured)
            if counted["long"]:
                links = links.unionByName(_grouped_links(lists.where(~short), nodes, rows, repeated, k, percent))
        labels = components(links)
        if last:
            break
        lists = written(_labelled(lists.where(~short).drop("members", "n_center"), labels), "jaccard-labelled")
        discard(held)
        still = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        held, lists = lists, _next_lists(lists.join(still, "key", "left_semi"), measured, percent, _files(counted[0]))
        discard(held, measured)
        held = lists
    discard(held)
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("label"))
    named = nodes.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = named.select("node", F.col("label").alias("group")).join(smallest.withColumnRenamed("label", "group"), "group").select("node", "component_id", "group")
    return sets.join(of_node.withColumnRenamed("node", "of"), (F.col("node") == F.col("of")) & (F.col("n") > 0), "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of smallest id. Texts without words stay."""
    found = written(similar_groups(docs, k, percent, id_col, text_col), "jaccard-groups")
    grouped = found.where("n_shingles > 0").groupBy("doc_id", "text_key").agg(
        F.any_value("component_id").alias("component_id"), F.any_value("group").alias("group"), F.count("*").alias("rows"))
    # Of rows that share the smallest id, the text of smallest hash; of equal rows, one.
    chosen = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.min("text_key").alias("chosen"))
    judged = written(grouped.join(chosen, "group").select(
        "doc_id", "text_key", "rows", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("chosen"))).alias("stays")), "jaccard-judged")
    gone = written(judged.where(~F.col("stays")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")), "jaccard-gone")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__key"))
    kept = docs.join(sized(gone), same, "left_anti")
    twice = judged.where("stays AND rows > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    if twice.limit(1).count():
        twice = written(twice, "jaccard-twice")
        once = kept.join(twice, same, "left_semi").dropDuplicates([id_col, text_col])
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept
