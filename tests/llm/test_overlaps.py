"""Groups of the n-gram join that are compared in memory."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.llm import jaccard, overlaps

from .test_brute_force import brute_components


def together(m, links):
    parent = list(range(m))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(m)]


@pytest.mark.parametrize("trial", range(24))
def test_links_bring_together_what_all_pairs_do(trial, monkeypatch):
    """Families with common and with few additions; sets of nobody; some together before; one block and two; small pieces."""
    rng = np.random.default_rng(trial)
    monkeypatch.setattr(overlaps, "ROWS", (1, 7, 256)[trial % 3])
    monkeypatch.setattr(overlaps, "GATHERED", (10, 1 << 22)[trial % 2])
    monkeypatch.setattr(overlaps, "RARE", (2, 32)[trial // 2 % 2])
    percent, m, base = (80, 90, 50)[trial // 3 % 3], int(rng.integers(1, 60)), rng.integers(0, 2**62, 40)
    sets = []
    for i in range(m):
        own = rng.integers(0, 300 if trial % 2 else 2**60, int(rng.integers(0, 8)))
        sets.append(np.unique(np.r_[rng.choice(base, int(rng.integers(25, 41)), replace=False), own] if i % 9 else rng.integers(0, 2**62, 30)))
    n, comp = np.array([len(x) for x in sets]), rng.integers(0, m, m) if trial % 3 == 0 else np.arange(m)
    block = rng.integers(0, 2, m) if trial % 4 == 1 else np.zeros(m, np.int64)
    a, b = overlaps.spanning_links(np.concatenate(sets), n, comp, block, percent)
    common = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    linked = (common * 100 >= (n[:, None] + n[None, :] - common) * percent) & ~np.eye(m, dtype=bool)
    assert len(a) < m and linked[a, b].all()
    before = [(int(i), int(np.flatnonzero(comp == comp[i])[0])) for i in range(m)]
    asked = linked & ((block[:, None] != block[None, :]) | (len(np.unique(block)) == 1))
    got, found = together(m, before + list(zip(a.tolist(), b.tolist()))), np.argwhere(asked).tolist()
    assert all(got[i] == got[j] for i, j in found)
    assert together(m, before + np.argwhere(linked).tolist()) == together(m, before + found + list(zip(a.tolist(), b.tolist()))) or len(np.unique(block)) == 2


def family(rng, copies):
    """Copies of a text with few to many edits: some link with it, some with each other only, some with none."""
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = {0: list(rng.choice(vocabulary, 160))}
    for i in range(1, copies):
        own, share = list(texts[0]), rng.uniform(0, 0.08)
        for at in np.flatnonzero(rng.random(len(own)) < share):
            own[at] = str(rng.choice(vocabulary))
        texts[i] = own
    return {i: " ".join(t) for i, t in texts.items()}


@pytest.mark.parametrize("blocks", [False, True])
def test_a_large_family_makes_no_table_of_pairs(spark, monkeypatch, blocks):
    """Pairs that go through tables are bounded by the copies, not by their pairs."""
    if blocks:
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", 40)
    rows, measure = [], jaccard._measured

    def measured(pairs, *rest):
        rows.append(pairs.count())
        return measure(pairs, *rest)

    monkeypatch.setattr(jaccard, "_measured", measured)
    texts = family(np.random.default_rng(8), 160)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df, 5, 80).collect()}
    want = brute_components(texts, 5, 80)
    assert got == want and 20 < len({c for _, c in want.values()}) < 120
    assert sum(rows) <= jaccard.SHORT * len(texts)
