"""Blocks of rows and of queries that meet in groups."""

import random

from brigade.llm import topk


def test_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "TASKS", 2)
    monkeypatch.setattr(topk, "SPAN", 3)
    r = random.Random(2)
    rows = [(i, [r.randint(-9, 9) / 256 for _ in range(3)]) for i in range(600)]
    whole = [(i, [round(256 * x) for x in v]) for i, v in rows]
    want = []
    for q, x in whole[::50]:
        best = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in whole if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), row_block=64, query_block=2).collect()
    assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got) == want
