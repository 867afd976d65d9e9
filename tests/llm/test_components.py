"""Components of links, by few rounds of jobs."""

import random

import numpy as np

from brigade.llm import components


def brute(links):
    low = {v: v for e in links for v in e}
    changed = True
    while changed:
        changed = False
        for x, y in links:
            m = min(low[x], low[y])
            if low[x] != m or low[y] != m:
                low[x] = low[y] = m
                changed = True
    return low


def shapes():
    r = random.Random(5)
    path = list(range(-70, 70))
    r.shuffle(path)
    name = r.sample(range(10**6, 10**9), 400)
    links = list(zip(path, path[1:]))  # a chain without order
    links += [(name[0], v) for v in name[1:150]]  # a hub
    links += [(r.choice(name[150:300]), r.choice(name[150:300])) for _ in range(110)]
    links += [(v, v) for v in (name[0], name[350], name[351], -70)]  # self-links
    links += [(y, x) for x, y in links[::3]] + links[::5]
    r.shuffle(links)
    return links


def test_components(spark):
    links = shapes()
    for tasks in (1, 7, 40):
        got = components.components(spark.createDataFrame(links, "a long, b long").repartition(tasks), "a", "b").collect()
        assert len(got) == len({r.node for r in got})
        assert {r.node: r.component for r in got} == brute(links)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_contract_begins_anew():
    import pyarrow as pa

    links = shapes()
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links[i : i + 9])], names=["x", "y"]) for i in range(0, len(links), 9)]
    for most in (4, 50, 1 << 20):
        rows = [e for b in components._contract(iter(batches), most) for e in zip(*(c.to_pylist() for c in b.columns))]
        assert brute(rows) == brute(links)
    x, y = components._stars(*(np.array(c) for c in zip(*links)))
    assert dict(zip(x.tolist(), y.tolist())) == brute(links)


def test_few_jobs(spark, monkeypatch):
    """A family whose links are dealt to many tasks settles in few tables written."""
    written = []
    original = components.stash
    monkeypatch.setattr(components, "stash", lambda df, name, *a: (written.append(name), original(df, name, *a))[1])
    r = random.Random(6)
    links = [(v, r.randrange(v)) for v in range(1, 600)]
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(12), "a", "b").collect()
    assert {x.component for x in got} == {0} and len(got) == 600
    assert len(written) <= 8, written
