"""The page step in Python against the column expressions that say the same, and what it leaves to Spark."""

import json

from pyspark.sql import functions as F

from brigade.functions.text import ascii_lower
from brigade.operators import classify, html, plain, recipe, sinks, steps
from brigade.operators.ingredients import parse_ingredient
from brigade.plans import catalogue
from tests.test_operators import LINES, column

SF = "/root/testdata/sf0.001"
MORE = ["2 à 4 C. À SOUPE de crème (400 g)", "- 1 ½ L d’eau", "sİx x", "deux œufs", "  POIVRE ", "1,5-2,5 kg de blé", "3 3/4 cl de vin", "9" * 320 + " g x", "0 x", "boîte de thon", "2 boites d'anchois", "\u3000", "ßa", "Σel", "film\nalimentaire", "laits de pois chichesx", "2\u00a0g de sésame"]
STEPS = [" étape 1: x", "Step 2 : Cuire 1 h 20", "1) à l'avance", "12.", "10 MIN", "v1.5", "0 h 0 puis 5 min", "9" * 25 + " min", "9" * 320 + " h", "1/2 h", "30\u2003mn", " \t "]
TIMES = ["PT1H30M", " p1dt1s ", "PT0M", "P", "P1W", "PT61S", None, "PT5M\u0085", "PT" + "9" * 320 + "S", "PT" + "9" * 320 + "H"]


def test_lines_as_the_columns_say(spark):
    texts = [x for x in LINES if x is not None] + MORE
    want = column(spark, texts, lambda c: F.struct(parse_ingredient(c).alias("i"), classify.aisle(parse_ingredient(c)["name"]).alias("aisle")))
    assert [(i := plain.ingredient(x)) and i[:4] for x in texts] == [w.i and (*w.i, w.aisle) for w in want]
    names = [w.i.name for w in want if w.i]
    kinds = column(spark, names, lambda c: F.struct(classify.allergens(F.array(c)).alias("a"), classify.seasonal(F.array(c)).alias("s"), classify.vegetarian(F.lit(None).cast("array<string>"), F.array(c)).alias("v")))
    assert [(plain.allergens_of(k), bool(k & plain._SEASON), not k & plain._MEAT) for k in map(plain.kinds_of, names)] == [tuple(k) for k in kinds]
    assert list(map(plain.lowered, texts)) == column(spark, texts, ascii_lower)


def test_steps_and_numbers_as_the_columns_say(spark):
    want = column(spark, STEPS, lambda c: steps.steps_normalize(F.array(c)))
    assert [[s[:2]] if (s := plain.step(x)) else [] for x in STEPS] == [[tuple(s) for s in w] for w in want]
    assert [plain.about_batches(x) for x in STEPS] == column(spark, STEPS, lambda c: classify.batch_friendly(c, F.lit(""), F.array(F.lit(""))))
    assert list(map(plain.iso_minutes, TIMES)) == column(spark, TIMES, classify.iso_duration)
    assert [plain.servings(x) for x in (*STEPS, None)] == column(spark, [*STEPS, None], classify.servings)


def test_nothing_but_python_works_on_pages(spark):
    """Expressions with lambdas and patterns are interpreted for every row: none is left beside the page step."""
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for only in (False, True):
        plan = recipe.normalize_nodes(pages, only_errors=only)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "regexp" not in plan and "rlike" not in plan and "lambda" not in plan


def test_numbers_in_json_are_looked_for_from_their_dot(spark):
    """A pattern that begins by looking back does so at every character of a text."""
    row = spark.createDataFrame([(2.0, -1.0, 2.5, 10.0, [1.0, 3.0], "v2.0, x")], "a double, b double, c double, d double, e array<double>, f string")
    out = sinks.sink_jsonl(row)
    assert out.first()[0] == '{"a":2,"b":-1,"c":2.5,"d":10,"e":[1,3],"f":"v2.0, x"}'
    assert ", (?<" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sink_is_read_by_one_parse_a_row(spark):
    assert "get_json_object" not in catalogue.QUERIES["dual_sink"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_head_in_any_case():
    node = json.dumps({"@type": "Recipe", "name": "x", "1": {"@type": "Recipe", "name": "one"}})
    for before in ("", "İ", "<script", "<SCRIPT x <link "):
        page = before + f"<Script TYPE='application/ld+json'>{node}</script><LINK rel=Canonical href=/c>"
        assert (html.first_recipe(page) or {}).get("name") == "x" and html.canonical_of(page) == "/c", before
