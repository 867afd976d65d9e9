"""JSON out: numbers as JavaScript prints them, absent keys for nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def to_js_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON; whole doubles lose their .0."""
    text = F.to_json(F.struct(*(columns or df.columns)))
    # looked for from the dot, so that what comes before is read there only
    return F.regexp_replace(text, r"\.0(?=[,}\]])(?<=[:,\[]-?\d{1,15}\.0)", "")


def sink_jsonl(df: DataFrame) -> DataFrame:
    return df.select(to_js_json(df).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    sink_jsonl(df).write.text(path)


def write_outcomes(rows: DataFrame, path: str, *, result: list[str], error: list[str], by: str = "error") -> tuple[int, int]:
    """Results and errors as JSON lines below ``path``, in outcome=results and outcome=errors, in one pass
    over ``rows`` and one commit; returns how many there are of each. Rows with ``by`` are errors."""
    seen = Observation()
    bad = F.col(by).isNotNull()
    rows = rows.observe(seen, F.count_if(~bad).alias("results"), F.count_if(bad).alias("errors"))
    value = F.when(bad, to_js_json(rows, error)).otherwise(to_js_json(rows, result))
    rows.select(value.alias("value"), F.when(bad, "errors").otherwise("results").alias("outcome")).write.partitionBy("outcome").text(path)
    return seen.get["results"], seen.get["errors"]


def sink_json(df: DataFrame, order: str, *, always_array: bool = False) -> DataFrame:
    """All rows as one JSON text, for results small enough to print: nothing for none, an object for
    one, else an array. ``always_array`` gives an array for any number."""
    one = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), to_js_json(df.drop(order)).alias("j")))).alias("all"))
    items = F.transform("all", lambda x: x["j"])
    array = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    text = array if always_array else F.when(F.size("all") == 1, F.get(items, F.lit(0))).when(F.size("all") > 1, array)
    return one.select(text.alias("value")).where("value is not null")
