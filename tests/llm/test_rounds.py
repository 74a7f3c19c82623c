"""What the rounds of the n-gram join carry on."""

from __future__ import annotations

import numpy as np

from tessera.llm import jaccard


def test_near_copies_that_link_with_nothing_make_no_lists(spark):
    """Members with more elements of their own than linked sets may differ by are done after their centre."""
    rng = np.random.default_rng(3)
    lists, measured = [(1, 0, 200, 0, 9.0, 0), (1, 1, 200, 0, 1.0, 0)], [(0, 1, 200, 200, True, 198, 202, True, [1000, 1001, 1, 2])]
    for i in range(2, 60):
        gone = rng.choice(200, 25, replace=False).tolist()
        lists.append((1, i, 200, i, 1.0, 0))
        measured.append((0, i, 200, 200, True, 175, 225, False, gone + [i * 10_000 + j for j in range(25)]))
    lists = spark.createDataFrame(lists, "key long, node long, n long, comp long, weight double, center long")
    measured = spark.createDataFrame(measured, "a long, b long, n_a long, n_b long, wide boolean, common int, total long, linked boolean, delta array<long>")
    assert jaccard._next_lists(lists, measured, 90, 2).count() == 0
    # A copy that shares what it has lost, and what it has instead, with another one meets it.
    twin = spark.createDataFrame([(0, 60, 200, 200, True, 175, 225, False, measured.where("b = 2").first().delta[:-1] + [7])], measured.schema)
    more = lists.unionByName(spark.createDataFrame([(1, 60, 200, 60, 1.0, 0)], lists.schema))
    out = jaccard._next_lists(more, measured.unionByName(twin), 90, 2).groupBy("key").agg({"node": "min", "comp": "max"}).collect()
    assert out and all(tuple(r)[1:] in ((2, 60), (60, 2)) for r in out)
