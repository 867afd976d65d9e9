"""License scans against plain Python."""

import random
import re

import pytest

from brigade.llm import licences

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    """(words, base places, base labels) word by word."""
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    places = [(i, label) for phrase, label in licences.BASE.items() for p in [phrase.encode().split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(places), sorted({x for _, x in places})


def test_query_against_plain_python(spark):
    rows = {r.doc_id: r for r in licences.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, (n, places, labels) = rows[d.doc_id], plain(d.text)
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(labels) <= set(r.labels.split(",") if r.labels else []) and 0 <= r.score <= 1
    assert sum(r.n_base for r in rows.values()) > 0


def test_places_in_chunks():
    random.seed(3)
    scan = licences.Scanner(tuple(licences.BASE.items()), tuple(licences.NOTICES.items()))
    vocabulary = ["cc", "by", "mit", "license", "apache", "gnu", "general", "public", "é x", "CC-BY", "MIT  License", "GNU\nGENERAL\tPUBLIC\0LICENSE"]
    for size in (0, 1, 5, 4000):
        text = " ".join(random.choices(vocabulary, k=size))
        n, places, _ = plain(text)
        for chunk in (1, 7, 100, 1 << 20):
            got_n, got = scan.places(text.encode(), chunk)
            assert got_n == n and sorted((w, x) for x, base, w in got if base) == places


@pytest.mark.parametrize(
    "text, valid, labels, chosen, obligation, expression",
    [
        ("mit", True, ["mit"], ["mit"], 2, "mit"),
        ("mit or apache-2.0", True, ["apache", "mit"], ["mit"], 2, "mit or apache-2.0"),
        ("gpl-2.0-only or mit and bsd-3-clause", True, ["bsd", "gpl", "mit"], ["bsd", "mit"], 2, "gpl-2.0-only or mit and bsd-3-clause"),
        ("(gpl-2.0+ or mit) and agpl-3.0", True, ["agpl", "gpl", "mit"], ["agpl", "mit"], 5, "(gpl-2.0+ or mit) and agpl-3.0"),
        ("gpl-2.0-or-later with classpath-exception-2.0 and mit", True, ["gpl", "mit"], ["gpl", "mit"], 3, "gpl-2.0-or-later with classpath-exception-2.0 and mit"),
        ("cc-by-nc-sa-4.0. more text", True, ["cc-by-nc"], ["cc-by-nc"], 6, "cc-by-nc-sa-4.0"),
        ("mit) and so on", True, ["mit"], ["mit"], 2, "mit"),
        ("licenseref-own", True, [], [], 7, "licenseref-own"),
        ("mit or", False, [], [], None, "mit or"),
        ("(mit", False, [], [], None, "(mit"),
        ("and mit", False, [], [], None, ""),
        ("()", False, [], [], None, "("),
        ("", False, [], [], None, ""),
        ("\nmit", False, [], [], None, ""),
    ],
)
def test_expressions(text, valid, labels, chosen, obligation, expression):
    got = licences.evaluate(text)
    assert (got["valid"], got["labels"], got["chosen"], got["obligation"], got["expression"]) == (valid, labels, chosen, obligation, expression)


def test_expressions_of_any_shape_against_recursion():
    """Random trees written with the fewest parentheses give what evaluating the tree gives."""
    random.seed(5)
    names = {"mit": 2, "gpl-3.0-only": 4, "agpl-3.0": 5, "lgpl-2.1+": 3, "cc0-1.0": 1, "x-own": 7}
    level = {"or": 1, "and": 2}

    def tree(depth):
        if depth == 0 or random.random() < 0.2:
            n = random.choice(list(names))
            with_ = random.random() < 0.2
            return n + " with some-exception" * with_, names[n] - (with_ and 3 <= names[n] <= 5), 3
        op = random.choice(["or", "and"])
        (t1, r1, l1), (t2, r2, l2) = tree(depth - 1), tree(depth - 1)
        wrap = lambda t, inner, right: f"({t})" if inner < level[op] or right and inner == level[op] and random.random() < 0.5 else t
        return f"{wrap(t1, l1, False)} {op} {wrap(t2, l2, True)}", (min if op == "or" else max)(r1, r2), level[op]

    for _ in range(500):
        text, obligation, _ = tree(random.randint(0, 6))
        got = licences.evaluate(text)
        assert got["valid"] and got["obligation"] == obligation and got["expression"] == text
    deep = "(" * 50_000 + "mit" + ")" * 50_000
    assert licences.evaluate(deep)["valid"] and not licences.evaluate(deep[:-1])["valid"]


def test_tags_and_edge_cases(spark):
    texts = [
        "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) */\nx", '{"license": "Apache-2.0"}', "License: see the file", "my-license: MIT", "license = 'BSD-3-Clause AND Nothing'", "SPDX-License-Identifier: Own-1.0",
        None, "", " \n", "MIT License. MIT license", "cc by sa 4", "word " * 400_000 + "gnu general public license",
    ]
    rows = [(i, t, "s", i, True) for i, t in enumerate(texts)] + [(9, texts[9], "s", 0, None), (None, texts[9], None, None, None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int, places boolean")
    got = licences.license_scan(t).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 9 for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert [by[i].labels for i in range(12)] == [["gpl", "mit"], ["apache"], [], [], [], [], [], [], [], ["mit"], ["cc-by", "cc-by-sa"], ["gpl"]]
    assert by[0].tags[0].chosen == ["mit"] and by[0].tags[0].obligation == 2 and by[5].tags[0].obligation == 7 and not by[5].tags[0].known
    assert [(p.word, p.base) for p in by[9].places] == [(0, True), (2, True)] and by[11].places[0].word == 400_000
    assert (by[6].n_words, by[8].n_words, by[6].score) == (0, 0, 0.0) and by[None].labels == ["mit"]
    assert licences.license_scan(t.limit(0)).count() == 0
