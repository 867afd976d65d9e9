"""Work on texts that many rows share: done once for each text, and whole."""

from pyspark.sql import functions as F

from brigade.operators.ingredients import parse_ingredient
from brigade.plans import catalogue
from brigade.sources.shared import each_text

SF = "/root/testdata/sf0.001"


def test_each_text(spark):
    lines = ["2 kg de farine", None, "", "sel", "2 kg de farine ", "Œufs"]
    rows = spark.createDataFrame([(i, lines[i % 6]) for i in range(600)] + [(600 + i, f"{i} g de noix") for i in range(300)], "id long, line string")
    made = parse_ingredient(F.col("line"))
    want = {(r.id, r.line, r.i) for r in rows.withColumn("i", made).collect()}
    got = each_text(rows, "line", {"i": made}).select("id", "line", "i").collect()
    assert len(got) == 900 and {(r.id, r.line, r.i) for r in got} == want


def test_lines_are_parsed_once_each(spark):
    """What is planned over the rows holds no pattern: these stand in the pass over the texts."""
    for name in ("ing_full", "ing_quantity", "ing_unit", "aisle", "aisle_counts", "keyword_match", "phrase_match", "allergen_rules"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan.lower() and "RLIKE" not in plan and "Join" in plan, name
