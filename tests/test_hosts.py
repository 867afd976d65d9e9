"""Host names in other scripts."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brigade.functions import hosts, urls


@pytest.mark.parametrize(
    "host, ascii_form",
    [
        ("fa\u00df.de", "xn--fa-hia.de"),  # sharp s stays, its capital becomes it
        ("FA\u1e9e.de", "xn--fa-hia.de"),
        ("\u0392\u03cc\u03bb\u03bf\u03c2.gr", "xn--nxasmm1c.gr"),  # final sigma stays
        ("a\u0301.com", "xn--1ca.com"),
        ("\u65e5\u672c\u3002jp", "xn--wgv71a.jp"),
        ("\uff41\uff0e\uff43\uff4f\uff4d", "a.com"),
        ("a\u00adb.com", "ab.com"),  # a soft hyphen is ignored
        ("\u0915\u094d\u200d\u0937.com", "xn--11b2ezcw70k.com"),  # a joiner after a virama
        ("\u0646\u0627\u0645\u0647\u200c\u0627\u06cc.com", "xn--mgba3gch31f060k.com"),  # a non-joiner between joining letters
        ("\u05d01.com", "xn--1-zhc.com"),
        ("xn--BCHER-KVA.example", "xn--bcher-kva.example"),
        ("x..com", "x..com"),
        ("a{b}.com", "a{b}.com"),
    ],
)
def test_forms(host, ascii_form):
    assert urls.host_of(urls.normalize(f"https://{host}/")) == ascii_form


@pytest.mark.parametrize(
    "host",
    [
        "xn--a", "xn--", "xn--abc-", "xn--.com", "xn--zn7c.com",  # punycode of nothing, of ASCII, of mapped characters
        "a\u200db.com", "ab\u200c.com",  # joiners without anything to join
        "\u0301a.com",  # a mark first
        "\u05d0a.com", "1\u05d0.com", "\u05d01\u0661.com",  # right-to-left text out of order
        "\ufffd.com", "\u202ea.com", "\ue000.com", "\u0378.com", "\u00ad", "a\u2024\u00a0b.com",
    ],
)
def test_rejected(host):
    assert urls.url_parts(f"https://{host}/")[2] == "Invalid URL"


def test_plain_expressions_leave_punycode_to_the_rules(spark):
    rows = ["https://xn--a.com/", "https://a.xn--bcher-kva.example/x", "https://a.com/xn--a", None]
    from pyspark.sql import functions as F

    u = urls.normalize_url(F.col("u"))
    got = spark.createDataFrame([(x,) for x in rows], "u string").select(u["host"].alias("h"), u["error"].alias("e")).collect()
    assert [tuple(r) for r in got] == [(None, "Invalid URL"), ("a.xn--bcher-kva.example", None), ("a.com", None), (None, "URL is required")]


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(min_codepoint=33), min_size=1, max_size=12))
def test_any_text(t):
    """What is accepted is ASCII, stays as it is a second time, and is also found from its own script."""
    try:
        once = hosts.to_ascii(t)
    except hosts.HostError:
        return
    assert once.isascii() and hosts.to_ascii(once) == once
    assert hosts.to_ascii(hosts.to_unicode(once)) == once
    assert hosts.to_ascii(unicodedata.normalize("NFC", t)) == once
