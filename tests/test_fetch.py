"""Pages from responses and the cache: each option of the command line, streams, the schedule of a busy host."""

import json
import random

from pyspark.sql import functions as F

from brigade import cli
from brigade.operators import cache
from brigade.streaming import pages as streams

NODE = {"@type": "Recipe", "name": "Riz", "recipeIngredient": ["200 g de riz", "sel"], "recipeInstructions": "Cuire 10 min. Servir.", "totalTime": "PT20M"}
RESPONSES = "url string, status int, html string, status_text string, resolved_url string, elapsed_ms long, headers array<struct<name:string,value:string>>, accept_language string, user_agent string"


def page(name):
    return f'<script type="application/ld+json">{json.dumps(NODE | {"name": name})}</script>'


def stored(spark, tmp_path, rows):
    full = [{"status": 200, "status_text": "OK"} | r for r in rows]
    names = [f.split(" ")[0] for f in RESPONSES.split(", ")]
    path = str(tmp_path / f"responses-{random.random()}")
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], RESPONSES).write.parquet(path)
    return path


def run(spark, capsys, tmp_path, *args, now=1_000_000):
    code = cli.main([*args, "--cache-path", str(tmp_path / "cache")], spark, now=now)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_cache_ttl_and_no_cache(spark, tmp_path, capsys):
    one, two = (stored(spark, tmp_path, [{"url": "https://a.b/x", "html": page(n)}]) for n in ("One", "Two"))
    name = lambda r: json.loads(r[1])["name"]
    assert name(run(spark, capsys, tmp_path, "extract", "a.b/x", "--responses", one)) == "One"
    assert name(run(spark, capsys, tmp_path, "extract", "a.b/x", "--responses", two, now=1_000_500)) == "One"
    assert name(run(spark, capsys, tmp_path, "extract", "a.b/x", "--responses", two, "--no-cache", now=1_000_500)) == "Two"
    assert name(run(spark, capsys, tmp_path, "extract", "a.b/x", "--responses", two, "--cache-ttl", "100ms", now=1_000_500)) == "Two"
    assert name(run(spark, capsys, tmp_path, "extract", "a.b/x", "--responses", one, now=1_000_600)) == "Two"
    assert cache.open_store(spark, str(tmp_path / "cache")).count() == 1


def test_status_text_timeout_and_redirects(spark, tmp_path, capsys):
    rows = [
        {"url": "https://a.b/x", "html": "", "status": 404, "status_text": "Not Found"}, {"url": "https://a.b/y", "html": page("Y"), "elapsed_ms": 900, "headers": [("Content-Type", "text/html"), ("X", "1"), ("x", "2")]},
        {"url": "https://a.b/z", "html": page("Z"), "resolved_url": "HTTPS://www.C.d:443/z#top"}, {"url": "https://a.b/w", "html": "", "status": 500, "status_text": None},
    ]
    at = stored(spark, tmp_path, rows)
    code, out, err = run(spark, capsys, tmp_path, "extract", "a.b/x", "a.b/y", "a.b/z", "a.b/w", "a.b/none", "--responses", at, "--timeout", "500")
    assert code == 1 and json.loads(out)["source_url"] == "https://www.c.d/z" and json.loads(out)["source_name"] == "www.c.d"
    for said in ("Request failed: 404 Not Found", "Request timed out after 500ms", "Request failed: 500 ", "No response"):
        assert said in err
    code, out, _ = run(spark, capsys, tmp_path, "extract", "a.b/y", "--responses", at, "--timeout", "1s")
    assert code == 0 and json.loads(out)["name"] == "Y"
    kept = {r.url: r for r in cache.open_store(spark, str(tmp_path / "cache")).collect()}
    assert set(kept) == {"https://a.b/y", "https://a.b/z"} and kept["https://a.b/z"].resolved_url == "https://www.c.d/z"
    assert json.loads(kept["https://a.b/y"].headers_json) == {"content-type": "text/html", "x": "1, 2"}


def test_rate_headers_and_plan(spark, tmp_path, capsys):
    rows = [{"url": "https://a.b/x", "html": page("French"), "accept_language": "fr", "user_agent": "me/1"}, {"url": "https://a.b/x", "html": page("English"), "accept_language": "en", "user_agent": "me/1"}, {"url": "https://a.b/y", "html": page("Any")}, {"url": "https://c.d/y", "html": page("Other")}]
    at, plan = stored(spark, tmp_path, rows), str(tmp_path / "plan")
    args = ["extract", "a.b/x", "a.b/y", "c.d/y", "--responses", at, "--no-cache", "--plan", plan, "--user-agent", "me/1", "--format", "jsonl"]
    for language, rate in (("fr", 300), ("en", 0), ("en", 9000)):
        _, out, _ = run(spark, capsys, tmp_path, *args, "--accept-language", language, "--rate", str(rate))
        assert [json.loads(x)["name"] for x in out.split("\n") if x] == [{"fr": "French", "en": "English"}[language], "Any", "Other"]
        sent = {r.url: r for r in spark.read.parquet(plan).collect()}
        assert sent["https://a.b/x"].start_ms == sent["https://c.d/y"].start_ms == 1_000_000
        assert rate <= sent["https://a.b/y"].start_ms - 1_000_000 <= rate + min(500, rate // 3)
        assert sent["https://a.b/x"].headers["Accept-Language"] == language and sent["https://a.b/x"].headers["User-Agent"] == "me/1"
    code, _, err = run(spark, capsys, tmp_path, "extract", "a.b/x", "--responses", at, "--accept-language", "fr", "--user-agent", "other")
    assert code == 1 and "No response" in err


def test_search_errors_and_fallback(spark, tmp_path, capsys):
    items = '<script type="application/ld+json">' + json.dumps({"@type": "ItemList", "itemListElement": ["/recettes/a-b", "https://elsewhere.org/c"]}) + "</script>"
    bad = '<a class="result__a" href="x&#x110000;">x</a>'
    link = '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fwww.750g.com%2Fr">R</a>'
    engine = "https://duckduckgo.com/html/?q="
    rows = [
        {"url": "https://www.marmiton.org/recettes/recherche.aspx?aqt=riz", "html": items}, {"url": "https://www.750g.com/recherche/?q=riz", "html": ""}, {"url": engine + "site%3A750g.com%20recette%20riz", "html": link},
        {"url": "https://www.cuisineaz.com/recettes/recherche_terme.aspx?recherche=riz", "html": ""}, {"url": engine + "site%3Aptitchef.com%20recette%20riz", "html": bad}, {"url": engine + "site%3Acuisineactuelle.fr%20recette%20riz", "html": "", "status": 503, "status_text": "Down"},
    ]
    at = stored(spark, tmp_path, rows)
    code, out, err = run(spark, capsys, tmp_path, "search", "riz", "--responses", at)
    assert code == 1 and [r["source_url"] for r in json.loads(out)] == ["https://www.marmiton.org/recettes/a-b", "https://www.750g.com/r"]
    lines = [x.split(" | ") for x in err.strip().split("\n") if " | " in x]
    assert [(x[0], x[-1]) for x in lines] == [("cuisineaz", "DuckDuckGo fallback failed: No response"), ("ptitchef", "Invalid code point 1114112"), ("cuisineactuelle", "Request failed: 503 Down"), ("journaldesfemmes", "No response")]
    assert cache.open_store(spark, str(tmp_path / "cache")).count() == 5  # a page that can't be parsed was fetched
    _, out, _ = run(spark, capsys, tmp_path, "search", "riz", "--responses", at, "--sites", "750g,marmiton", "--max-results", "1")
    assert [r["source_url"] for r in json.loads(out)] == ["https://www.750g.com/r"]


def test_streams(spark, tmp_path):
    """Pages that arrive in two files become recipes; responses in two batches keep the store up to date."""
    at = str(tmp_path / "pages")
    for i in range(2):
        spark.createDataFrame([(i, f"https://a.b/{i}", page(f"R{i}")), (i + 10, "https://a.b/q", "")], streams.PAGES).coalesce(1).write.mode("append").parquet(at)
    q = streams.recipe_stream(spark, at).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.page_id, r.name, r.error) for r in got if not r.error) == [(0, "R0", None), (1, "R1", None)] and len(got) == 4
    kind = "seq long, " + cache.STORE
    for n in range(3):  # the second batch overwrites two URLs and adds one; the third touches one
        rows = [(10 * n + i, f"https://a.b/{i + n}", 100 * n + i, "r", 200, "{}", f"body{n}-{i}") for i in range(3 if n < 2 else 1)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        writes = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        streams.upsert_batches(writes, str(tmp_path / "store"), str(tmp_path / "c2"), buckets=2).trigger(availableNow=True).start().awaitTermination()
    kept = {r.url[-1]: r.body for r in cache.open_store(spark, str(tmp_path / "store")).collect()}
    assert kept == {"0": "body0-0", "1": "body1-0", "2": "body2-0", "3": "body1-2"}
    again = spark.read.parquet(str(tmp_path / "in"))
    cache.upsert_store(again, str(tmp_path / "store"), buckets=2)
    assert {r.url[-1]: r.body for r in cache.open_store(spark, str(tmp_path / "store")).collect()} == kept


def test_schedule_of_a_busy_host(spark):
    """One host has most requests, over many spans of numbers; request by request gives the same."""
    random.seed(1)
    rows, at = [], 0
    for seq in range(3000):
        at += random.choice([0, 0, 10, 400, 5000])
        rows.append((seq, "busy" if seq % 7 else f"h{seq % 5}", at - random.randint(0, 50)))
    free, want = {}, {}
    for seq, host, arrival in rows:
        want[seq] = max(arrival, free.get(host, arrival))
        free[host] = want[seq] + 300 + seq % 100
    t = spark.createDataFrame(rows, "seq long, host string, arrival_ms long").repartition(7)
    for span in (64, 1 << 16):
        got = cache.rate_schedule(t, delay_ms=300, jitter=F.col("seq") % 100, span=span)
        assert {r.seq: r.start_ms for r in got.collect()} == want
