"""A commit to a store moves its rows once, and keeps the last of each key."""

from pyspark.sql import functions as F

from brigade.operators import cache, refresh
from tests.test_refresh import feed


def test_rows_are_shuffled_once(spark, tmp_path):
    old = feed(spark, [(i, f"old {i}") for i in range(40)]).drop("seq")
    new = feed(spark, [(i, f"new {i}") for i in range(20, 60)])
    named = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64("url"), F.lit(8)).cast("int"))
    made = cache.cache_upsert(named(old), named(new))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "_bucket" in made.columns
    assert {(r.url, r.body) for r in made.collect()} == {(f"https://a.b/{i}", f"{'old' if i < 20 else 'new'} {i}") for i in range(60)}
    again = refresh.replaced(named(old), named(new.drop("seq")))
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {(r.url, r.body) for r in again.collect()} == {(r.url, r.body) for r in made.collect()}


def test_commits_by_bucket_equal_others(spark, tmp_path):
    one, two = (cache.page_store(spark, str(tmp_path / n), 8) for n in "ab")
    for rows in ([(i, f"x{i}") for i in range(30)], [(3, "y"), (50, "z")]):
        for store, by in ((one, False), (two, True)):
            store.upsert(feed(spark, rows), cache.cache_upsert, by_bucket=by)
    rows = [sorted(map(tuple, s.frame().collect())) for s in (one, two)]
    assert rows[0] == rows[1] and len(rows[0]) == 31
    assert set(one.version()[1]["folders"]) == set(two.version()[1]["folders"])
