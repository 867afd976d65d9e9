"""The data source of stored responses: files of any split, filters, streams, commits."""

import gzip
import io
import random

import pytest

from brigade.operators import cache
from brigade.sources import responses


def rows_of(df):
    return sorted((r.url, r.status, r.html) for r in df.collect())


@pytest.fixture()
def table(spark):
    random.seed(4)
    responses.register(spark)
    odd = ["", "é漢\0x", "WARC/1.0\r\nWARC-Type: response\r\nno length\r\n\r\n", "a\r\n\r\nb", "x" * 5000]
    rows = [(f"https://h{i % 5}.org/{i}", [200, 404, 500][i % 3], odd[i % 5] + str(i), [("X-A", f"v{i}"), ("Content-Type", "text/html; charset=latin-1")], "Not Found" if i % 3 == 1 else None, i) for i in range(60)]
    return spark.createDataFrame(rows, "url string, status int, html string, headers array<struct<name:string,value:string>>, status_text string, elapsed_ms long").repartition(3)


def test_round_trip_in_splits_of_any_size(spark, table, tmp_path):
    want = rows_of(table)
    for compression in ("", "gzip"):
        at = str(tmp_path / f"r{compression}")
        table.write.format("responses").mode("append").option("compression", compression).save(at)
        for split in (1 << 26, 700):
            got = spark.read.format("responses").option("splitBytes", split).load(at)
            assert rows_of(got) == want
        one = got.where("url = 'https://h1.org/1'").first()
        assert (one.host, one.status, one.status_text, one.elapsed_ms) == ("h1.org", 404, "Not Found", 1)
        assert {(h.name, h.value) for h in one.headers} == {("X-A", "v1"), ("Content-Type", "text/html; charset=utf-8")}
    table.limit(2).write.format("responses").mode("overwrite").save(at)
    assert spark.read.format("responses").load(at).count() == 2
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith("_")]


def test_filters_are_pushed_down(spark, table, tmp_path):
    at = str(tmp_path / "r")
    table.write.format("responses").mode("append").save(at)
    got = spark.read.format("responses").load(at).where("host in ('h1.org', 'h2.org') and status = 200 and length(html) > 3")
    assert rows_of(got) == [x for x in rows_of(table) if x[0].startswith(("https://h1.", "https://h2.")) and x[1] == 200 and len(x[2]) > 3]
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(host, [h1.org,h2.org]), EqualTo(status,200)]" in plan
    reader = responses.Reader({"path": at})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("status",), 200), GreaterThan(("status",), 1), EqualTo(("url",), "x")]))
    assert len(left) == 2 and reader.statuses == {200} and reader.wants("any", 200) and not reader.wants("any", 404)


def test_failed_write_leaves_nothing(spark, table, tmp_path):
    at = str(tmp_path / "r")
    table.write.format("responses").mode("append").save(at)
    before = rows_of(spark.read.format("responses").load(at))
    bad = table.selectExpr("if(status = 500, cast(null as string), url) url", "assert_true(status < 500) x", "status", "html")
    with pytest.raises(Exception):
        bad.write.format("responses").mode("append").save(at)
    assert rows_of(spark.read.format("responses").load(at)) == before
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith("_")]


def test_stream_of_files_and_fetched_pages(spark, table, tmp_path):
    at, seen = tmp_path / "r", []
    at.mkdir()
    rows = table.collect()
    for n in range(3):
        (at / f"{n}.warc").write_bytes(b"".join(responses._record(r.asDict(True)) for r in rows[20 * n : 20 * n + 20]))
        q = spark.readStream.format("responses").load(str(at)).writeStream.foreachBatch(lambda b, i: seen.append(rows_of(b))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [len(s) for s in seen] == [20, 20, 20] and sorted(sum(seen, [])) == rows_of(table)
    asked = spark.createDataFrame([(1, "https://h0.org/0"), (2, "https://h1.org/1")], "seq long, url string")
    pages = cache.fetch_pages(asked, spark.read.format("responses").load(str(at)), now_ms=5, ttl_ms=1).orderBy("seq").collect()
    assert [p.html for p in pages] == ["0", None] and pages[1].fetch_error == "Request failed: 404 Not Found"


def test_records_of_other_makers():
    """Plain line ends, folded headers, chunks, compressed bodies, other record types, broken lines."""
    body = gzip.compress("<p>é</p>".encode("latin-1"))
    chunked = b"%x\r\n%s\r\n3;x=1\r\n%s\r\n0\r\n\r\n" % (len(body) - 3, body[:-3], body[-3:])
    one = b"HTTP/1.0 200 OK\nContent-Type: text/html;\n charset='ISO-8859-1'\nTransfer-Encoding: chunked\nContent-Encoding: gzip\n\n" + chunked
    data = b"junk\nWARC/1.1\nWARC-Type: warcinfo\nContent-Length: 3\n\nabc\n\nWARC/1.1\nWARC-Type: response\nWARC-Target-URI: <HTTPS://U@Host.org:8/x>\nContent-Length: %d\n\n%s\n\nWARC/1.0\nWARC-Type: response\nContent-Length: 2\n\nxx" % (len(one), one)
    got = [r for named, content in responses.records(io.BytesIO(data)) if (r := responses.parsed(named, content))]
    assert [(r[0], r[1], r[2], r[3], r[8]) for r in got] == [("HTTPS://U@Host.org:8/x", "host.org", 200, "OK", "<p>é</p>")]
    assert responses.parsed({"warc-type": "response", "warc-target-uri": "x"}, b"no head")[2] is None
