"""Runs against a request-by-request simulation; slots over passes, batches and restarts; the store's versions."""

import random

import pytest
from pyspark.sql import functions as F

from brigade.operators import cache
from brigade.sources.store import Store
from brigade.streaming import pages as streams

PAGE = "url string, fetched_at_ms long, resolved_url string, status int, headers_json string, body string"


def simulate(requests, answers, kept, ttl, rate, slots):
    """{(url, seq): (start, fetched at, from the store)} of (seq, url, arrival) taken one after another."""
    kept, out, of_store = dict(kept), {}, set(kept)
    for seq, url, t in sorted(requests, key=lambda r: (r[0] is None, r[0])):
        if (url, seq) in out:
            continue
        if url in kept and t - kept[url] <= ttl:
            out[url, seq] = (None, kept[url], url in of_store)
            continue
        host = url.split("/")[2]
        start = max(t, slots.get(host, t))
        slots[host] = start + rate
        ok, elapsed = answers.get(url, (False, 0))
        if ok:
            kept[url] = start + elapsed
            of_store.discard(url)
        out[url, seq] = (start, start + elapsed if ok else None, False)
    return out


def planned(spark, requests, answers, kept, ttl, rate, slots, arrival, now=0):
    r = spark.createDataFrame(requests, "seq long, url string, t long")
    a = spark.createDataFrame([(u, ok, n) for u, (ok, n) in answers.items()], "url string, ok boolean, elapsed_ms long")
    c = spark.createDataFrame(list(kept.items()), "url string, fetched_at_ms long")
    s = spark.createDataFrame(list(slots.items()), "host string, next_ms long")
    got = cache.plan_requests(r, a, c, now_ms=now, ttl_ms=ttl, rate_ms=rate, jitter_ms=0, arrival=arrival, state=s).collect()
    last = (1 << 63) - 1
    return {(x.url, None if x.at == last else x.at): (x.start_ms, x.fetched_at_ms, x.stored) for x in got}


def a_run(n, spread, late=50):
    rows, at = [], 1000
    for seq in range(n):
        at += random.choice([0, 0, 1, spread])
        url = "https://h0/u0" if seq % 3 == 0 else f"https://h{random.randint(0, 2)}/u{random.randint(0, 3)}"  # one has a third of all
        rows.append((seq, url, at - random.randint(0, late)))
    rows += [rows[5], (None, "https://h0/u0", at), (None, "https://h9/x", at + 10**6)]
    urls = sorted({u for _, u, _ in rows})
    answers = {u: (random.random() < 0.8, random.randint(0, 40)) for u in urls if random.random() < 0.9}
    kept = {u: random.randint(0, 2000) for u in urls if random.random() < 0.5}
    return rows, answers | {"https://h0/u0": (True, 7)}, kept


@pytest.mark.parametrize("ttl, rate, spread", [(300, 40, 30), (10**9, 100, 50), (1, 0, 3)])
def test_repeated_urls_at_several_times(spark, ttl, rate, spread):
    random.seed(ttl + rate)
    rows, answers, kept = a_run(60, spread)
    slots = {"h1": 1500, "h7": 9}
    assert planned(spark, rows, answers, kept, ttl, rate, slots, "t") == simulate(rows, answers, kept, ttl, rate, dict(slots))


def test_all_at_once(spark):
    random.seed(9)
    rows, answers, kept = a_run(120, 10)
    rows = [(s, u, 2500) for s, u, _ in rows]
    want = simulate(rows, answers, kept, 800, 40, {"h0": 4000})
    assert planned(spark, rows, answers, kept, 800, 40, {"h0": 4000}, None, now=2500) == want
    assert planned(spark, rows, answers, kept, 800, 40, {"h0": 4000}, "t") == want
    assert planned(spark, [], {}, {}, 1, 1, {}, None) == planned(spark, [], {}, {}, 1, 1, {}, "t") == {}


def test_pages_of_a_run(spark):
    """Bodies, times and errors of a run; requests without seq or URL are kept; clashing columns pass."""
    responses = spark.createDataFrame([("https://a/x", 200, "X", 30), ("https://a/y", 404, "no", 5)], "url string, status int, html string, elapsed_ms long")
    kept = spark.createDataFrame([("https://a/z", 900, "https://a/z2", 200, "{}", "Z"), ("https://a/x", 1, "https://a/x", 200, "{}", "old")], PAGE)
    asked = [(1, "https://a/x"), (2, "https://a/x"), (3, "https://a/y"), (4, "https://a/y"), (5, "https://a/z"), (6, None), (None, "https://a/x"), (None, "https://a/w")]
    got = cache.fetch_pages(spark.createDataFrame([(*r, "own") for r in asked], "seq long, url string, p_at string"), responses, kept, now_ms=1000, ttl_ms=500, rate_ms=100, jitter_ms=0).collect()
    rows = {(r.seq, r.url): (r.html, r.from_cache, r.start_ms, r.fetched_at_ms, r.fetch_error) for r in got}
    assert len(got) == 8 and {r.p_at for r in got} == {"own"}
    assert rows[1, "https://a/x"] == ("X", False, 1000, 1030, None)
    assert rows[2, "https://a/x"] == rows[None, "https://a/x"] == ("X", True, None, 1030, None)
    assert rows[3, "https://a/y"] == (None, False, 1100, None, "Request failed: 404 ") and rows[4, "https://a/y"][2] == 1200
    assert rows[5, "https://a/z"] == ("Z", True, None, 900, None) and rows[None, "https://a/w"] == (None, False, 1300, None, "No response")
    assert rows[6, None] == (None, False, None, None, None)


def test_passes_share_slots_and_pages(spark, tmp_path):
    responses = spark.createDataFrame([(f"https://a/{i}", 200, f"B{i}") for i in range(4)], "url string, status int, html string")
    ask = lambda *urls: spark.createDataFrame(list(enumerate(urls)), "seq long, url string")
    store, limits = cache.page_store(spark, str(tmp_path / "s"), 4), cache.limit_store(spark, str(tmp_path / "l"), 2)
    starts = []
    for now, passes in ((1000, [["0", "1"], ["1", "2", "9"]]), (1500, [["3"]])):  # the second run begins while the first one's slots last
        run = cache.Run(spark, responses, store, now_ms=now, ttl_ms=100_000, rate_ms=1000, jitter_ms=200, limits=limits)
        for urls in passes:
            run(ask(*[f"https://a/{u}" for u in urls]))
        run.remember()
        starts += [r.start_ms for r in run.sent().collect()]
        if now == 1000:
            assert [r.from_cache for r in run.pages[1].orderBy("seq").collect()] == [True, False, False]
    assert len(starts) == 5 and all(b - a >= 1000 for a, b in zip(sorted(starts), sorted(starts)[1:]))
    assert sorted(r.body for r in store.frame().collect()) == ["B0", "B1", "B2", "B3"]


def test_schedule_of_a_stream_in_batches(spark, tmp_path):
    """Three batches, with a restart between, and one batch give the same."""
    random.seed(6)
    rows, at = [], 0
    for seq in range(90):
        at += random.choice([0, 5, 400])
        rows.append((seq, f"h{random.choice([0, 0, 0, 1, 2])}", at))
    kind = "seq long, host string, arrival_ms long"
    want = {r.seq: r.start_ms for r in cache.rate_schedule(spark.createDataFrame(rows, kind), delay_ms=300, jitter=F.col("seq") % 50).collect()}
    for n in range(3):
        spark.createDataFrame(rows[30 * n : 30 * n + 30], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        q = streams.schedule_batches(stream, str(tmp_path / "out"), str(tmp_path / "limits"), str(tmp_path / "c"), delay_ms=300, jitter=F.col("seq") % 50, state_buckets=2)
        q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.seq: r.start_ms for r in got} == want and len(got) == 90


def entries(spark, *rows):
    return spark.createDataFrame([(s, u, t, u, 200, "{}", body) for s, u, t, body in rows], "seq long, " + PAGE)


def test_writers_lose_nothing(spark, tmp_path):
    """A second writer commits while the first is at work, on the same bucket and on others."""
    path = str(tmp_path / "s")
    cache.upsert_store(entries(spark, (0, "a", 1, "a0"), (0, "b", 1, "b0")), path, buckets=2)
    one, merges = cache.page_store(spark, path), []
    before = one.frame()

    def merge(old, new):
        if not merges:
            cache.upsert_store(entries(spark, *[(0, f"k{i}", 2, "other") for i in range(6)], (0, "a", 2, "a-other")), path)
        merges.append(sorted(r.body for r in old.collect()))
        return cache.cache_upsert(old, new)

    one.upsert(entries(spark, (0, "b", 3, "b1"), (0, "c", 3, "c1")), merge)
    got = {r.url: r.body for r in one.frame().collect()}
    assert got == {"a": "a-other", "b": "b1", "c": "c1"} | {f"k{i}": "other" for i in range(6)}
    assert len(merges) == 2 and one.version()[0] == 3  # merged again over what the other has committed
    assert {r.url: r.body for r in before.collect()} == {"a": "a0", "b": "b0"}  # a reader keeps its version
    with pytest.raises(ZeroDivisionError):
        one.upsert(entries(spark, (0, "a", 9, "lost")), lambda old, new: 1 // 0)
    cut = one._commit
    one._commit = lambda *a: 1 // 0  # killed before the commit
    with pytest.raises(ZeroDivisionError):
        one.upsert(entries(spark, (0, "a", 9, "lost")), cache.cache_upsert)
    one._commit = cut
    assert {r.url: r.body for r in one.frame().collect()} == got
    assert not one._commit(3, {}) and one.version()[0] == 3
    assert one.vacuum(keep=1) > 0 and {r.url: r.body for r in one.frame().collect()} == got
    assert one.upsert(entries(spark), cache.cache_upsert) == 3  # nothing to write
    for _ in range(2):  # a batch is committed once
        one.upsert(entries(spark, (0, "d", 4, "d")), cache.cache_upsert, stream="x", batch=7)
    assert one.version()[0] == 4 and one.applied("x") == 7


def test_lookup_reads_few_buckets_and_fresh_bodies(spark, tmp_path):
    path = str(tmp_path / "s")
    cache.upsert_store(entries(spark, *[(0, f"https://a/{i}", 500 * (i % 2), f"body{i}") for i in range(200)]), path, buckets=16)
    store = cache.page_store(spark, path)
    asked = spark.createDataFrame([(0, "https://a/1"), (1, "https://a/2")], "seq long, url string")
    responses = spark.createDataFrame([("https://a/2", 200, "new")], "url string, status int, html string")
    assert len(store.lookup(asked, "url").inputFiles()) <= 2 < len(store.frame().inputFiles())
    pages = cache.fetch_pages(asked, responses, store, now_ms=600, ttl_ms=300, rate_ms=0)
    assert [(r.html, r.from_cache) for r in pages.orderBy("seq").collect()] == [("body1", True), ("new", False)]
    plan = pages._jdf.queryExecution().sparkPlan().toString().split("\n")
    scans = [x for x in plan if "FileScan" in x and path in x]
    assert len(scans) == 1 and "fetched_at_ms" in scans[0].split("PushedFilters")[1]  # bodies are read once, of fresh entries
    assert not any("Window" in x for x in plan)  # the schedule has none


def test_buckets_of_any_key(spark, tmp_path):
    store = Store(spark, str(tmp_path / "n"), "host string, next_ms long", "host", 3)
    rows = spark.createDataFrame([("a", 1), (None, 5), ("b", 2)], "host string, next_ms long")
    store.upsert(rows, cache.later_slots)
    store.upsert(spark.createDataFrame([("a", 0), ("b", 9)], "host string, next_ms long"), cache.later_slots)
    assert {r.host: r.next_ms for r in store.frame().collect()} == {"a": 1, "b": 9}
