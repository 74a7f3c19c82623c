"""Ranked search, line dedup and vector codes against plain versions, and their edge cases."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes, lines, queries, ranked

from .conftest import EDGE_ROWS, LONG, SF, texts_of

EMPTY = hashlib.sha256(b"").hexdigest()
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


# ---------------------------------------------------------------- ranked search


def plain_ranking(docs, items, top=10):
    """(item, rank, doc_id, score) over (id, text) documents; items: id -> text."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length, df = len(bags), sum(b.total() for _, b in bags), collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items.items():
        rows = []
        for i, bag in bags:
            m = 25 + 75 * bag.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if score > 0:
                rows.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(rows, key=lambda r: (r[0], r[1], r[2] or 0))[:top])]
    return out


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


RANKED = ("item_id", "rank", "doc_id", "score")


def test_search_against_plain_ranking(spark):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()}
    assert rows(queries.op11_ranked_search(spark, SF), *RANKED) == sorted(plain_ranking(list(texts_of().items()), items), key=str)


def test_search_edges(spark, edges, nothing):
    items = [(1, "The second text, of the ID: one two"), (2, None), (3, "..."), (4, "word5x5 word5x5 été"), (None, "zzz passage"), (5, "nowhere")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items] + [(4, "Straße", "x", 1)], "item_id long, text string, doc_id string, score int")
    want = {i: t for i, t in items}
    want[4] += " Straße"
    got = ranked.search(edges, table)
    assert rows(got, *RANKED) == sorted(plain_ranking([(r[0], r[1]) for r in EDGE_ROWS], want), key=str)
    assert {r.item_id for r in got.collect()} == {1, 4, None}
    assert ranked.search(nothing, table).count() == 0 and ranked.search(edges, table.where("false")).count() == 0
    assert ranked.search(edges, table.where("item_id = 3")).columns == list(RANKED)


def test_search_ties_and_copies(spark):
    docs = [(i, "same words here") for i in range(100, 0, -1)] + [(7, "same words here")] * 3 + [(None, "same words here")] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(ranked.search(df, spark.createDataFrame([(1, "same here")], "item_id long, text string"), top=12).collect(), key=lambda r: r["rank"])
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5, 6, 7, 7, 7, 7, 8, 9] and len({r.score for r in got}) == 1


def test_search_in_groups_blocks_and_chunks(spark, monkeypatch):
    whole = rows(queries.op11_ranked_search(spark, SF), *RANKED)
    monkeypatch.setattr(ranked, "GROUP_TERMS", 500)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 60)
    monkeypatch.setattr(ranked, "CHUNK", 1)
    assert rows(queries.op11_ranked_search(spark, SF), *RANKED) == whole


def test_search_terms_by_pieces(monkeypatch):
    text = ("Ünder-Taker x9 " * 50 + LONG[:5000]).encode()
    whole = ranked.count_terms(text)
    monkeypatch.setattr(ranked, "PIECE", 7)
    assert ranked.count_terms(text) == whole and whole[b"taker"] == 50


def test_search_prunes_whole_nodes():
    rng = np.random.default_rng(5)
    # Twenty topics with terms of their own: an item's own topic holds its best documents.
    topic = np.repeat(np.arange(20), 64)
    x = np.zeros((len(topic), 400))
    for d, t in enumerate(topic):
        x[d, rng.choice(20, 8, replace=False) + 20 * t] = rng.integers(1, 1000, 8)
    q = np.zeros((40, 400))
    for i in range(40):
        q[i, rng.choice(20, 10, replace=False) + 20 * (i % 20)] = rng.integers(1, 1000, 10)
    best = ranked.Best(np.zeros(40, np.int64), 10)
    scored = ranked.search_chunk(list(range(len(x))), x, np.arange(40), q, ranked.Hierarchy.build(q, ranked.ITEM_LEAF), best)
    product = q @ x.T
    for i in range(40):
        want = sorted((-int(s), False, d) for d, s in enumerate(product[i]) if s > 0)[:10]
        assert best.rows[i] == want
    assert scored < 0.25 * product.size


# ---------------------------------------------------------------- line dedup


def plain_lines(docs):
    """Per row (doc_id, n_lines, n_dropped, sha256) of (id, text) rows."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    order = lambda i: (i is None, i or 0)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(i)
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)], key=order) == i]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


REPORT = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
LINE_ROWS = [
    (1, "A line of several words\nshort\n\ta LINE of several words \nown line of the first"), (2, "\n\nshort\na line of several words\n"), (3, "A line of several words"),
    (3, "own line of the third\nA line of several words"), (4, "own line of the third"), (None, "only the unnamed hold this"), (None, "only the unnamed hold this\nown line of the third"),
    (5, "été été é\nété été éà\r\n123456789\x0b1"), (6, "ÉTÉ ÉTÉ ÉÀ\nété été éà"), (7, "été été é"), (8, "\n"), (9, None), (10, ""),
    (11, "the very same row\nof two lines here"), (11, "the very same row\nof two lines here"), (12, "of two lines here\nnot a line not a line\x85of them"),
]


def test_lines_against_plain_version(spark):
    assert rows(queries.op12_line_dedup(spark, SF), *REPORT) == plain_lines(list(texts_of().items()))


def test_lines_edges(spark, edges, nothing):
    df = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in LINE_ROWS], "doc_id long, text string, one int, index string, gone int").repartition(4)
    got = rows(lines.remove_repeats(df, report=True), *REPORT)
    assert got == plain_lines(LINE_ROWS)
    out = lines.remove_repeats(df)
    assert out.columns == df.columns and out.schema == df.schema
    texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert sorted((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts if i) == sorted((r[0], r[3]) for r in got if r[0])
    assert (9, None) in texts and (10, "") in texts and (3, "") in texts and (None, "only the unnamed hold this") in texts
    assert rows(lines.remove_repeats(edges, report=True), *REPORT) == plain_lines([r[:2] for r in EDGE_ROWS])
    assert lines.remove_repeats(nothing, report=True).count() == 0 and lines.remove_repeats(nothing).count() == 0


def test_lines_in_many_shards_and_salts(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 3)
    monkeypatch.setattr(lines, "SALT_PROBES", 4)
    docs = [(i, "a line that all of them hold\n" + "\n".join(f"line number {k} of many" for k in range(i % 7, 40, 1 + i % 5))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows(lines.remove_repeats(df, report=True), *REPORT) == plain_lines(docs)
    named = [(f"id{i:03d}", t) for i, t in docs]
    got = rows(lines.remove_repeats(spark.createDataFrame(named, "doc_id string, text string"), report=True), "doc_id", "n_dropped")
    assert got == sorted((f"id{i:03d}", n) for i, _, n, _ in plain_lines(docs))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    one, two = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
    one[: n // 2] = 7  # equal halves are told apart by the other one
    built = lines.PerfectHash.build(one, two)
    again = lines.PerfectHash.load(built.sizes, np.packbits(built.bits).tobytes())
    assert sorted(again.slots(one, two)) == list(range(n))
    others = again.slots(one + np.uint64(1), two)
    assert others.min(initial=0) >= -1 and others.max(initial=-1) < n


# ---------------------------------------------------------------- vector codes


def plain_codes(vectors, parts=8, entries=16, rounds=6):
    """codes, errors and codebooks of (id, whole-number vector) pairs."""
    x = {i: np.array(v, object).reshape(parts, -1) for i, v in vectors}
    first = sorted(x)[:entries]
    books = [[x[i][p].copy() for i in first] for p in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = collections.defaultdict(list)
            for v in x.values():
                of[nearest(v[p], books[p])].append(v[p])
            books[p] = [np.array([sum(c) // len(of[e]) for c in zip(*of[e])], object) if e in of else old for e, old in enumerate(books[p])]
    codes_, errors = {}, {}
    for i, v in x.items():
        own = [nearest(v[p], books[p]) for p in range(parts)]
        codes_[i] = "".join(f"{e:02x}" for e in own)
        errors[i] = sum(far(v[p], books[p][e]) for p, e in enumerate(own))
    return codes_, errors, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_codes_against_plain_lloyd(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    want, errors, sha = plain_codes([(r["vec_id"], [math.floor(4096 * x) for x in r["embedding"]]) for r in table])
    per = collections.Counter()
    for r in table:
        per[r["label"]] += errors[r["vec_id"]]
    label = {r["vec_id"]: r["label"] for r in table}
    got = queries.op13_vector_codes(spark, SF).collect()
    assert len(got) == len(table)
    for r in got:
        assert (r.code, r.error, r.label_error, r.codebooks_sha256) == (want[r.vec_id], errors[r.vec_id], per[label[r.vec_id]], sha)


def test_walk_agrees_with_all_distances_and_skips_most():
    rng = np.random.default_rng(3)
    middle = rng.integers(-4000, 4000, (12, 4))
    points = middle[rng.integers(0, 12, 3000)] + rng.integers(-200, 200, (3000, 4))
    points[:40] = points[0]
    entries = np.concatenate([middle, middle[:2], points[:2]])  # equal entries: the lower index wins
    tree, order = codes.Tree.build(points)
    chosen, counts, sums, measured = codes.walk(tree, entries)
    far = ((points[order][:, None] - entries) ** 2).sum(2)
    assert (chosen == far.argmin(1)).all() and (np.bincount(chosen, minlength=16) == counts).all()
    assert all((sums[e] == points[order][chosen == e].sum(0)).all() for e in range(16))
    assert len(measured) < 0.5 * len(points)
    for n, k in ((1, 1), (1, 16), (7, 3), (9, 16), (40, 5)):
        tree, order = codes.Tree.build(points[:n] + np.arange(n)[:, None] * 7 % 5)
        chosen = codes.walk(tree, entries[:k])[0]
        assert (chosen == ((tree.points[:, None] - entries[:k]) ** 2).sum(2).argmin(1)).all()


def test_codes_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [((i * 7 + k * 3) % 11) / 5 - 1 for k in range(8)], i % 3 if i % 4 else None) for i in range(1, 30)]
    bad = [(-1, None, 0), (-2, [nan] * 8, 0), (-3, [1.0] * 7 + [inf], 0), (-4, [None] + [1.0] * 7, 1), (-5, [-inf] * 8, None)]
    more = [(5, [9.0] * 8, 1), (None, [0.5] * 8, 2), (40, [], 2), (41, [1.0], 2), (42, [1e30] * 8, 2)]
    df = spark.createDataFrame([(i, v, c, "x", 1) for i, v, c in good + bad + more], "vec_id long, embedding array<double>, label int, id string, error int").repartition(3)
    got = codes.compress(df).collect()
    assert sorted((r.vec_id for r in got), key=str) == sorted([i for i, _, _ in good + more], key=str)
    assert len({r.codebooks_sha256 for r in got}) == 1 and all(len(r.code) == 16 and r.error >= 0 for r in got)
    for label in {r.label for r in got}:
        of = [r for r in got if r.label == label]
        assert {r.label_error for r in of} == {sum(r.error for r in of)}
    few = codes.compress(df.where("vec_id between 1 and 3")).collect()
    assert {r.code for r in few} == {"00" * 8, "01" * 8, "02" * 8} and {r.error for r in few} == {0}
    assert codes.compress(df.where("false")).count() == 0
    assert {r.code for r in codes.compress(df.where("vec_id = 40")).collect()} == {"00" * 8}
    same = spark.createDataFrame([(i % 5, [0.25] * 16, None) for i in range(500)], "vec_id long, embedding array<float>, label int").repartition(4)
    assert {(r.code, r.error, r.label_error) for r in codes.compress(same).collect()} == {("00" * 8, 0, 0)}


def test_codes_do_not_depend_on_blocks(spark, monkeypatch):
    whole = rows(queries.op13_vector_codes(spark, SF), "vec_id", "code", "error", "codebooks_sha256")
    monkeypatch.setattr(codes, "BLOCK", 64 * 20)
    df = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy(F.col("label"), F.col("vec_id").desc()).repartition(7)
    assert rows(codes.compress(df), "vec_id", "code", "error", "codebooks_sha256") == whole
