"""Rules from a table against the patterns made of the same phrases."""

import random
import re

import pytest

from brigade.functions.rules import AISLE_RULES, ALLERGEN_RULES
from brigade.functions.text import keyword_regex
from brigade.operators import classify


def test_rules_against_patterns(spark):
    random.seed(1)
    rules = [(a, k) for a, ks in AISLE_RULES + ALLERGEN_RULES for k in ks] + [("x", "bons bois"), ("x", "a b a"), ("x", "Œufs à la coque"), ("none", "!?"), ("none", None)]
    vocabulary = sorted({w + e for _, k in rules if k for w in k.lower().split() for e in ("", "s", "x", "ss", "xs")} | {"de", "bon", "boi", "a", "b", "", "œuf", "COQUE", "l'ail"})
    texts = [(i, " ".join(random.choices(vocabulary, k=random.randint(0, 14)))) for i in range(400)] + [(400, None), (401, ""), (402, "a b a b a")]
    t = spark.createDataFrame(texts, "id long, line string")
    r = spark.createDataFrame([(i, p) for i, (_, p) in enumerate(rules)], "rule int, phrase string")
    found = classify.match_rules(t, r, key=["id"], text="line", rule=["rule"]).collect()
    folded = {i: re.sub("[^a-z0-9]+", " ", classify.fold(x or "")).strip() for i, x in texts}
    want = {(i, n) for n, (_, p) in enumerate(rules) if p and re.search("[a-z]", p.lower()) for i, x in folded.items() if re.search(keyword_regex([p]), x)}
    assert {(f.id, f.rule) for f in found} == want and len(want) > 500
    again = [(f.pos) for f in found if f.id == 402 and rules[f.rule][1] == "a b a"]
    assert sorted(again) == [0, 2]


def test_many_rules_in_one_join(spark):
    """20,000 keywords: one join, no pattern; a rule of too many words is an error."""
    r = spark.range(20_000).selectExpr("id rule", "concat('w', id, ' x', id % 7) phrase")
    t = spark.range(300).selectExpr("id", "concat('a w', id * 50, ' x', id * 50 % 7, ' w1') line")
    got = classify.match_rules(t, r, key=["id"], text="line", rule=["rule"])
    assert sorted((x.id, x.rule, x.pos) for x in got.collect()) == [(i, 50 * i, 1) for i in range(300)]
    assert "Join" in got._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="more words"):
        classify.match_rules(t, spark.createDataFrame([(1, "w0 " * 9)], "rule int, phrase string"), key=["id"], text="line", rule=["rule"]).collect()
