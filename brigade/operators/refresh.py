"""Recipes kept up to date with a store of pages: only pages that have changed are read and normalised again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stash
from ..sources.store import Store, last_of
from .recipe import normalize_nodes


def result_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """Recipes and errors by their pages' URLs."""
    pages = spark.createDataFrame([], "url string, html string, resolved_url string")
    return Store(spark, path, normalize_nodes(pages, keep=["url"]).schema, "url", buckets)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows, one of each URL, in place of ``old`` ones of the same URL."""
    return last_of(old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True))), "url", ["_new"]).drop("_new")


def refresh(pages: Store, results: Store) -> int:
    """Bring ``results`` up to the newest version of ``pages``; returns that version's number.

    The results' manifest names the version that they are of, and both change in one commit: a run that
    broke off is done again, one that another has done isn't. A page's new result, a recipe or an
    error, takes the place of its old one. Where the old version was vacuumed all pages are read.
    """
    since = max(0, results.applied("pages"))
    rows, number = pages.changes(since)
    if number <= since:
        return number
    made = normalize_nodes(rows.select("url", rows.body.alias("html"), "resolved_url"), keep=["url"])
    results.upsert(stash(made, "refreshed"), replaced, by_bucket=True, stream="pages", batch=number)
    return number
