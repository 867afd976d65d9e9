"""Incremental extraction against a batch run; results and errors in one pass."""

import json

from brigade import cli
from brigade.operators import cache, recipe, refresh
from brigade.streaming import pages as streams
from tests.test_fetch import page

KIND = "seq long, " + cache.STORE


def feed(spark, rows):
    return spark.createDataFrame([(n, f"https://a.b/{i}", n, f"https://a.b/{i}", 200, "{}", html) for n, (i, html) in enumerate(rows)], KIND)


def outcome(df):
    return sorted((r.url, r.name if r.error is None else None, r.error) for r in df.collect())


def test_refresh_equals_a_batch(spark, tmp_path):
    store, results = cache.page_store(spark, str(tmp_path / "s"), 4), refresh.result_store(spark, str(tmp_path / "r"), 2)
    feeds = [[(i, page(f"R{i}")) for i in range(6)], [(1, ""), (2, page("New")), (9, page("R9"))], [(1, page("Back"))]]
    assert refresh.refresh(store, results) == 0 and results.frame().count() == 0
    changed = []
    for n, rows in enumerate(feeds):
        before = store.version()[0]
        store.upsert(feed(spark, rows), cache.cache_upsert)
        changed.append(store.changes(before)[0].count())
        for _ in range(2):  # the second time there's nothing to do
            assert refresh.refresh(store, results) == n + 1
        kept = store.frame().selectExpr("url", "body html", "resolved_url")
        assert outcome(results.frame()) == outcome(recipe.normalize_nodes(kept, keep=["url"]))
    assert changed == [6, 3, 1] and results.version()[0] == 3
    store.upsert(feed(spark, [(3, page("Later"))]), cache.cache_upsert)
    store.vacuum(keep=1)  # the version that the results are of is gone: all pages are read
    assert store.changes(3)[0].count() == 7 and refresh.refresh(store, results) == 4
    assert dict((u, n) for u, n, _ in outcome(results.frame()))["https://a.b/3"] == "Later"


def test_stream_of_changes(spark, tmp_path):
    for n in range(2):
        feed(spark, [(i, page(f"R{i}-{n}") if i else "") for i in range(2 * n, 3)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        writes = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
        streams.extract_batches(writes, str(tmp_path / "s"), str(tmp_path / "r"), str(tmp_path / "c"), buckets=2).trigger(availableNow=True).start().awaitTermination()
    got = outcome(refresh.result_store(spark, str(tmp_path / "r"), 2).frame())
    assert got == [("https://a.b/0", None, "No recipe data found"), ("https://a.b/1", "R1-0", None), ("https://a.b/2", "R2-1", None)]


def test_output_of_results_and_errors(spark, tmp_path):
    at, out = str(tmp_path / "responses"), str(tmp_path / "out")
    spark.createDataFrame([("https://a.b/x", 200, page("X")), ("https://a.b/y", 404, "")], "url string, status int, html string").write.parquet(at)
    args = ["extract", "a.b/x", "a.b/y", "::", "--responses", at, "--no-cache", "--output"]
    assert cli.main([*args, out], spark, now=1) == 1
    lines = {k: sorted(r.value for r in spark.read.text(f"{out}/outcome={k}").collect()) for k in ("results", "errors")}
    assert [json.loads(x)["name"] for x in lines["results"]] == ["X"]
    assert [json.loads(x)["url"] for x in lines["errors"]] == ["::", "https://a.b/y"]
    assert cli.main(["extract", "a.b/x", "--responses", at, "--no-cache", "--output", out + "2"], spark, now=1) == 0
