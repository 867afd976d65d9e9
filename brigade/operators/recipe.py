"""From pages to validated recipes: one narrow stage, with an error column instead of exceptions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.jscompat import js_trim, struct_type
from ..functions.rules import AISLES, ALLERGENS, UNITS
from . import plain
from .html import read_page

FIELDS = ["name", "description", "vegetarian", "max_prep_time", "is_seasonal", "batch_friendly", "base_servings", "allergens", "ingredients", "steps", "source_name", "source_url", "source_license", "source_attribution"]


def violations(r: dict[str, Column]) -> Column:
    """The names of the schema's constraints that a recipe breaks."""
    blank = lambda c: c.isNull() | (js_trim(c) == "")
    bad_line = lambda i: blank(i["name"]) | ~((i["quantity"] > 0) & (i["quantity"] < float("inf")) & ~F.isnan(i["quantity"])) | ~i["unit"].isin(UNITS) | ~F.coalesce(i["aisle"].isin(AISLES), F.lit(True))
    checks = [
        ("name", blank(r["name"])), ("description", r["description"].isNull()), ("max_prep_time", ~r["max_prep_time"].between(5, 300)), ("base_servings", ~r["base_servings"].between(1, 20)),
        ("allergens", ~F.forall(r["allergens"], lambda a: a.isin(ALLERGENS))), ("ingredients", (F.size(r["ingredients"]) < 2) | F.exists(r["ingredients"], bad_line)),
        ("steps", (F.size(r["steps"]) < 2) | F.exists(r["steps"], lambda s: blank(s["description"]) | F.coalesce(s["minutes"] <= 0, F.lit(False)))),
        ("source_name", blank(r["source_name"])), ("source_url", r["source_url"].isNull() | ~F.coalesce(r["source_url"].rlike("^https?://[^/]"), F.lit(False))), ("source_license", blank(r["source_license"])), ("source_attribution", blank(r["source_attribution"])),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())


DONE = "name string, description string, vegetarian boolean, max_prep_time int, is_seasonal boolean, batch_friendly boolean, base_servings int, allergens array<string>, source_name string, source_url string, source_license string, source_attribution string, error string"
_LINE, _STEP = struct_type("name string, quantity double, unit string, aisle string"), struct_type("description string, minutes bigint")


def _done() -> T.StructType:
    of = {f.name: f for f in struct_type(DONE)} | {"ingredients": T.StructField("ingredients", T.ArrayType(_LINE)), "steps": T.StructField("steps", T.ArrayType(_STEP))}
    return T.StructType([of[c] for c in (*FIELDS, "error")])


def _lists(rows: list[list[tuple] | None], kind: T.StructType) -> pa.Array:
    """Lists of structs from lists of their fields' values."""
    ends, flat = [0], []
    for r in rows:
        flat += r or ()
        ends.append(len(flat))
    offsets = pa.array(ends, pa.int32(), mask=np.array([r is None for r in rows] + [False]))
    values = [pa.array([x[i] for x in flat], to_arrow_type(f.dataType)) for i, f in enumerate(kind)]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, fields=list(to_arrow_type(kind))), type=to_arrow_type(T.ArrayType(kind)))


def _each(work, arrays: tuple[pa.Array, ...]) -> list:
    """``work(page, html, fetch_error, overrides)`` of every page."""
    return [work(read_page(h, u), h or "", e, over) for h, u, e, *over in zip(*(a.to_pylist() for a in arrays))]


def _pages(*, only_errors: bool):
    """The one pass over pages in Python: (html, url, error of fetching, overrides of name, license and attribution) to recipes, or errors alone."""
    if only_errors:

        @F.arrow_udf(struct_type("error string"))
        def extract_page(html: pa.Array, url: pa.Array, fetch_error: pa.Array, name: pa.Array, licence: pa.Array, attribution: pa.Array) -> pa.Array:
            errors = _each(plain.error_alone, (html, url, fetch_error, name, licence, attribution))
            return pa.StructArray.from_arrays([pa.array(errors, pa.string())], ["error"])

    else:

        @F.arrow_udf(_done())
        def extract_page(html: pa.Array, url: pa.Array, fetch_error: pa.Array, name: pa.Array, licence: pa.Array, attribution: pa.Array) -> pa.Array:
            rows = _each(plain.whole, (html, url, fetch_error, name, licence, attribution))
            kinds = {"ingredients": _LINE, "steps": _STEP}
            values = [_lists([r[f.name] for r in rows], kinds[f.name]) if f.name in kinds else pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in _done()]
            return pa.StructArray.from_arrays(values, fields=list(to_arrow_type(_done())))

    return extract_page


def normalize_nodes(pages: DataFrame, *, keep: list[str] | None = None, only_errors: bool = False) -> DataFrame:
    """Rows of the recipe's fields and ``error`` from (url, html, and optionally overrides name,
    license and attribution of the source, the URL that answered as resolved_url, and an error of fetching).

    The error is the first that applies: fetching, no recipe, bad URL, no name, under two
    ingredients, under two steps, a yield without text, the schema. Each page goes to Python once and comes
    back whole, so nothing is shuffled. ``only_errors`` leaves out the fields
    that no error depends on, and gives (keep, error).
    """
    have = pages.columns
    own = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    keep = keep if keep is not None else [c for c in ("page_id", "url") if c in have]
    asked = F.coalesce(own("resolved_url"), F.col("url"))
    read = _pages(only_errors=only_errors)(F.col("html"), asked, own("fetch_error"), *[own(f"source_{k}_override") for k in ("name", "license", "attribution")])
    # exploding an array of one keeps filters on the result from being moved below, which would
    # evaluate the Python function once more
    done = pages.select(*keep, F.explode(F.array(read)).alias("done"))
    return done.select(*keep, *[F.col(f"done.{c}").alias(c) for c in (*([] if only_errors else FIELDS), "error")])


def valid(recipes: DataFrame) -> DataFrame:
    return recipes.where("error is null").drop("error")


def errors(recipes: DataFrame) -> DataFrame:
    return recipes.where("error is not null").select(*[c for c in recipes.columns if c not in FIELDS])
