"""Alignment of two tokenizers against plain Python over whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest

from brigade.llm import alignment, bpe, pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tok():
    return alignment.Tokenizers(bpe.default_path(), pieces.default_path())


def groups_of(a, b):
    """Groups of (end, id) lists of both sides."""
    common = sorted({e for e, _ in a} & {e for e, _ in b})
    out, at = [], 0
    for c in common:
        out.append(([i for e, i in a if at < e <= c], [i for e, i in b if at < e <= c]))
        at = c
    return out


def plain(tok, texts):
    """A row for each text, by the libraries over whole texts."""
    rows, held = [], collections.Counter()
    for t in texts:
        data = (" " + (t or "")).encode()
        a, b = tok.own.encode(" " + (t or ""), add_special_tokens=False).ids, tok.sp.encode(t or "")
        whole = t and all(b"".join(side[i] for i in ids) == data for side, ids in ((tok.a_bytes, a), (tok.b_bytes, b)))
        if not whole:
            rows.append(([], [], []))
            continue
        ends = lambda ids, side: list(zip(np.cumsum([len(side[i]) for i in ids]).tolist(), ids))
        common = {e for e, _ in ends(a, tok.a_bytes)} & {e for e, _ in ends(b, tok.b_bytes)}
        found, cur = {}, None
        for side, ids, names in ((0, a, tok.a_bytes), (1, b, tok.b_bytes)):
            n, cur = 0, []
            for e, i in ends(ids, names):
                cur.append(i)
                if e in common:
                    found.setdefault(n, [None, None])[side] = cur
                    n, cur = n + 1, []
        groups = [found[n] for n in sorted(found)]
        rows.append((a, b, groups))
        held.update({(x, y) for p, q in groups for x in p for y in q})
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups in rows:
        links = [(x, y) for p, q in groups for x in p for y in q]
        said = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out


def rows_of(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_query_against_plain_python(spark, tok):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    assert rows_of(alignment.query(spark, SF)) == plain(tok, [d.text for d in docs])


def test_odd_texts(spark, tok):
    random.seed(8)
    letters = ["a", "b", " ", "  ", "\n", "é", "ÿ", "漢字", "👍🏽", "▁", "<0x41>", "<s>", "</s>", "<|endoftext|>", "word", " the", "ing", "0", "1234", "\0", "​", "﻿", "　", "'s", "…", "ﬁ"]
    texts = [None, "", " ", "\n", "a", "the same text", "the same text", "▁", "a" * 9000, " " * 5000, "漢" * 3000, "=" * 70_000, "word " * 60_000 + "é" * 40]
    texts += ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(120)]
    texts += [" ".join(random.choices(["ab", "the", "e1", "naïve", "漢字"], k=20_000))]
    t = spark.createDataFrame([(i, x, i, "p") for i, x in enumerate(texts)], "doc_id long, text string, row int, pairs string").repartition(3)
    want = plain(tok, texts)
    assert sum(w[0] == 0 for w in want) > 10 and sum(w[0] > 0 for w in want) > 60
    for section, hold in ((1 << 20, 1 << 21), (5000, 4)):
        assert rows_of(alignment.align(t, section=section, hold=hold)) == want
    again = alignment.align(spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (3, "c")], "doc_id long, text string")).collect()
    assert [r.n_a for r in again] == [2, 2, 2, 1] or sorted(r.n_a for r in again) == [1, 2, 2, 2]
    assert alignment.align(t.limit(0)).count() == 0


def test_machine_holds_only_the_open_group():
    """Random events fed in runs of any size; wide groups; documents that end unaligned."""
    random.seed(2)
    for trial in range(30):
        runs, want = [], {}
        for row in range(random.randint(1, 6)):
            sides = [sorted(random.sample(range(1, 400), random.randint(0, 120))) + [400] * (random.random() < 0.9) for _ in (0, 1)]
            sides = [[(e, 10 * (e - b) + random.randint(0, 9)) for b, e in zip([0, *s], s)] for s in sides]  # ids tell lengths
            groups = groups_of(*sides)
            want[row] = (len(sides[0]), len(sides[1]), len(groups), sum(len(p) * len(q) for p, q in groups), collections.Counter((x, y) for p, q in groups for x in p for y in q), ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups))
            mine = [(row, 0, 0, [])]
            for side in (0, 1):
                for at in range(0, 401, 50):
                    part = [(e, i) for e, i in sides[side] if at < e <= at + 50]
                    if part:
                        mine.append((row, part[0][0] - part[0][1] // 10, side, [i for _, i in part]))
            runs += sorted(mine, key=lambda r: r[:3])
        machine = alignment.Sweep([np.arange(5000) // 10] * 2, hold=random.choice([4, 1 << 21]), products=random.choice([3, 1 << 21]))
        got, pairs, at = {}, collections.defaultdict(collections.Counter), 0
        records = []
        while at < len(runs):
            n = random.randint(1, 9)
            part, at = runs[at : at + n], at + n
            records += machine.feed(np.array([r[0] for r in part]), [r[0] for r in part], np.array([r[1] for r in part]), np.array([r[2] for r in part]), [np.array(r[3], np.int64) for r in part])
        records += machine.close()
        for row, _, n_a, n_b, n_groups, n_links, sha, last, whole, p, times in records:
            for x, n in zip(p.tolist(), times.tolist()):
                pairs[row][x >> 21, x & (1 << 21) - 1] += n
            if last:
                got[row] = (n_a, n_b, n_groups, n_links, sha)
        for row, (n_a, n_b, n_groups, n_links, links, said) in want.items():
            assert got[row] == (n_a, n_b, n_groups, n_links, hashlib.sha256(said.encode()).hexdigest() if n_groups else ""), trial
            assert pairs[row] == links
