"""Queries that answer for every row of their tables, against brute force."""

import __spark_entry__ as entry
from brigade.operators import steps
from brigade.plans import synthetic

SF = "/root/testdata/sf0.001"


def test_steps_split(spark, tmp_path):
    """Turns of several lines are split as well, whatever ends their lines."""
    texts = ["a\nb", "a\r\nb. c", "\n a. b\r", "a\rb\n\n \nc", " \n ", "", None, "Un. Deux; Trois.", "x"]
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for at in (str(tmp_path), SF):
        rows = spark.read.parquet(f"{at}/conversations.parquet").collect()
        got = entry.queries()["steps_split"](spark, at).collect()
        assert sorted((r.conv_id, r.turn, r.n) for r in got) == sorted((r.conv_id, r.turn, len(steps.split_text(r.text or ""))) for r in rows)
    assert any("\n" in r.text for r in rows)


def test_rate_schedule(spark, tmp_path):
    """Request by request, beyond the events that the recursive SQL looks at."""
    rows = spark.range(7000).selectExpr("id AS event_id", "id % 50 AS user_id", "timestamp_millis(1700000000000 + id * 37 % 1000000 + id * 11) AS ts", "'x' AS event_type", "'{}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    for at, base in ((str(tmp_path), 7000), (SF, spark.read.parquet(f"{SF}/events.parquet").count())):
        events = spark.read.parquet(f"{at}/events.parquet").selectExpr("event_id", "unix_millis(to_utc_timestamp(cast(ts as timestamp), 'UTC'))").collect()
        free, want = {}, {}
        for seq, arrival in sorted(map(tuple, events)):
            want[seq] = max(arrival, free.get(seq % 97, arrival))
            free[seq % 97] = want[seq] + 1500 + seq % 500
        got = entry.queries()["rate_schedule"](spark, at).collect()
        assert len(got) == base and {r.seq: r.start_ms for r in got} == want


def test_ing_unit(spark):
    """One row for each ingredient line, with units where a bullet comes first and none behind a glued one."""
    got = entry.queries()["ing_unit"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    lines = {(r.recipe_id, r.pos): (r.t, r.unit if r.t < 8 or r.t == 12 else None) for r in synthetic.lines(spark, SF).collect()}
    rows = got.collect()
    assert {lines[r.recipe_id, r.pos][0] for r in rows} == set(range(16))
    assert all((r.unit, r.factor) == ((u := lines[r.recipe_id, r.pos])[1], (10 if u[0] == 2 else 1) if u[1] else None) for r in rows)
