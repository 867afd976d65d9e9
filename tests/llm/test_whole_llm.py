"""Training-data operators that leave nothing out, against brute force."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brigade.llm import kneser_ney, ngram_join

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def test_kneser_ney_keeps_bigrams_seen_once(spark):
    """Scores of a bigram model of all counts, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).cache()
    ends = lambda t: ["<", *WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), ">"]
    rows = {r.doc_id: ends(r.text) for r in docs.collect()}
    train = [w for i, w in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    pairs = collections.Counter(p for w in train for p in zip(w, w[1:]))
    follows = collections.Counter(w for _, w in pairs)
    seen, mass = collections.Counter(), collections.Counter()
    types = {w for t in train for w in t[1:]}

    def discounts(counts):
        n = [0, *(max(1, sum(c == k for c in counts)) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2])
        return [0.0, *(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) for k in (1, 2, 3))]

    d, low = discounts(pairs.values()), discounts(follows.values())
    for (h, _), c in pairs.items():
        seen[h] += c
        mass[h] += d[min(c, 3)]
    rest = sum(low[min(f, 3)] for f in follows.values()) / len(pairs)

    def score(h, w):
        lower = max(follows[w] - low[min(follows[w], 3)], 0) / len(pairs) + rest / (len(types) + 1)
        c = pairs[h, w]
        return math.log10((c - d[min(c, 3)]) / seen[h] * (c > 0) + mass[h] / seen[h] * lower) if seen[h] else math.log10(lower)

    assert sum(c == 1 for c in pairs.values()) > 1000
    for r in kneser_ney.scores(docs).collect():
        assert r.score == pytest.approx(sum(score(h, w) for h, w in zip(rows[r.doc_id], rows[r.doc_id][1:])), rel=1e-6)


def test_ngram_join_counts_every_link(spark):
    """Families of one block and of several, and pairs that only columns between clusters find."""
    random.seed(17)
    rows = []
    for copies, length, changed in ((100, 200, [0, 1]), (600, 60, [0, 1]), (60, 80, [0, 1, 2, 3]), (40, 12, [0, 1])):
        base = ["w" + str(random.random()) for _ in range(length)]
        for _ in range(copies):
            t = list(base)
            for at in random.sample(range(length), random.choice(changed)):
                t[at] = "z" + str(random.random())
            rows.append((len(rows), " ".join(t)))
    t = spark.createDataFrame([*rows, (len(rows), None)], "doc_id long, text string")
    for k, num, den in ((4, 85, 100), (2, 3, 5)):
        sets = collections.defaultdict(list)
        for i, text in rows:
            w = text.split()
            sets[frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))].append(i)
        found = collections.Counter()
        for x, y in itertools.combinations(sets, 2):
            if den * (c := len(x & y)) >= num * (len(x) + len(y) - c):
                found.update((x, y))
        want = {i: found[x] for x, ids in sets.items() for i in ids} | {len(rows): 0}
        assert max(want.values()) > 256
        assert {r.doc_id: r.n_links for r in ngram_join.ngram_components(t, words=k, threshold=(num, den)).collect()} == want


def test_runs_are_cut_at_the_whole_key():
    """Parts of one hot column that meet in a task don't come together again."""
    rnd = np.random.default_rng(3)
    rows = np.sort(rnd.integers(0, 12, 4000))
    cols = [np.zeros(4000, np.int64), rows, rnd.integers(0, 9, 4000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 100]) for c in cols], names=["a", "p", "b"]) for i in range(0, 4000, 100)]
    got = list(ngram_join._runs(iter(batches), 2, most=500))
    assert all(np.array_equal(np.concatenate([g[k] for g in got]), cols[k]) for k in range(3))
    seen = [set(g[1].tolist()) for g in got]
    assert len(got) > 4 and all(not (x & y) for i, x in enumerate(seen) for y in seen[:i])


def test_ngram_join_blocks_by_bytes(spark):
    """A family of long texts in blocks of a few sets has the links of one in a single block."""
    base = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(base[: 2800 + 10 * i])) for i in range(12)]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(x.split()[j : j + 5]) for j in range(len(x.split()) - 4)} for i, x in rows}
    want = {i: sum(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in sets if j != i) for i in sets}
    original = ngram_join._cluster_links
    for size in (32 << 20, 60_000):
        ngram_join._cluster_links = lambda *a, size=size: original(*a, block_bytes=size)
        try:
            got = ngram_join.ngram_components(t).collect()
        finally:
            ngram_join._cluster_links = original
        assert {r.doc_id: r.n_links for r in got} == want and {r.component_id for r in got} == {0}
