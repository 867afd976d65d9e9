"""Search pages to ranked, filtered, de-duplicated and capped links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions.jscompat import WS_CHARS, collapse_ws, js_trim, rx, struct_type
from ..functions.rules import ENGINE_HOST, FALLBACK_SITES
from ..functions.text import decode_text
from ..functions.urls import fallback_name, host_allowed, host_of, normalize, parse, resolve
from ..sources.shared import stash
from .html import has_type, jsonld_texts, parse_json, tidy, walk
from .steps import truthy

_ATTR = r"\b{}[WS]*=[WS]*(?:\"([^\"]*)\"|'([^']*)'|([^\"'>WS]+))".replace("WS", re.escape(WS_CHARS))
_ANCHOR = re.compile(r"<a\b([^>]*)>(.*?)</a>", re.I | re.S | re.A)


def _elements(value, base: str):
    """(url, name) of the elements of an item list's itemListElement, in order."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, str) and v:
            yield resolve(v, base), None
        elif isinstance(v, dict):
            item = v.get("item")
            inner = item if isinstance(item, dict) else {}
            name = v["name"].strip(WS_CHARS) if isinstance(v.get("name"), str) else inner["name"].strip(WS_CHARS) if isinstance(inner.get("name"), str) else None
            spots = [v.get("url"), v.get("@id"), item if isinstance(item, str) else None, inner.get("@id"), inner.get("url")]
            spec = next((s for s in spots if isinstance(s, str)), None)
            yield resolve(spec, base) if spec else None, name or None


def itemlist_links(html: str, base: str) -> list[tuple[str, str | None]]:
    out = []
    for text in jsonld_texts(html):
        for obj in walk(parse_json(text)):
            if has_type(obj, "ItemList") and truthy(obj.get("itemListElement")):
                out += [(u, n) for u, n in _elements(obj["itemListElement"], base) if u]
    return out


def unwrap(href: str, base: str) -> str | None:
    """A result link's target: the search engine's own links name it in a parameter, decoded once."""
    from urllib.parse import parse_qs

    url = resolve(href, base)
    if url is None:
        return None
    host = host_of(url)
    if host == ENGINE_HOST or host.endswith("." + ENGINE_HOST):
        target = parse_qs(parse(url)[3][1:], keep_blank_values=True).get("uddg", [""])[0]
        try:
            return normalize(target) if target else None
        except (ValueError, UnicodeError):
            return None
    return url


def anchor_links(html: str, base: str) -> list[tuple[str, str | None]]:
    out = []
    for m in _ANCHOR.finditer(html):
        if not re.search(r"\bresult__a\b", m[1], re.I | re.A):
            continue
        href = re.search(_ATTR.format("href"), m[1], re.I | re.A)
        href = href and next((g for g in href.groups() if g is not None), "")
        url = unwrap(decode_text(href).strip(WS_CHARS), base) if href else None
        if url:
            out.append((url, tidy(decode_text(re.sub("<[^>]*>", " ", m[2]))) or None))
    return out


def _hits(html, base, engine):
    try:
        base = normalize(base or "")
        found = (anchor_links if engine else itemlist_links)(html or "", base)
        return {"hits": [{"pos": i, "url": u, "name": n, "host": host_of(u)} for i, (u, n) in enumerate(found)], "error": None}
    except (ValueError, OverflowError, UnicodeError) as e:
        return {"hits": [], "error": str(e) or "Unreadable page"}


@F.pandas_udf(T.StructType([T.StructField("hits", T.ArrayType(struct_type("pos int, url string, name string, host string"))), T.StructField("error", T.StringType())]))
def parse_search(html: pd.Series, base: pd.Series, engine: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_hits(*x) for x in zip(html, base, engine)], columns=["hits", "error"])


def is_engine(host: Column) -> Column:
    return (host == ENGINE_HOST) | host.endswith("." + ENGINE_HOST)


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (html, base_url, engine) with ``x``, their hits and what went wrong with parsing them."""
    return pages.withColumn("x", F.explode(F.array(parse_search(F.col("html"), F.col("base_url"), F.col("engine")))))


def page_hits(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, url, name) for each page (html, base_url, engine, allowed), the first of each URL kept."""
    return parsed_hits(parse_pages(pages), keys)


def parsed_hits(parsed: DataFrame, keys: list[str]) -> DataFrame:
    hits = parsed.select(*keys, "allowed", F.explode("x.hits").alias("hit")).select(*keys, "allowed", "hit.*")
    return dedup_in_page(hits.where(host_allowed(F.col("host"), F.col("allowed"))).select(*keys, "pos", "url", "name"), keys)


def page_errors(parsed: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, message) of the pages that couldn't be fetched or parsed."""
    return parsed.withColumn("message", F.coalesce("fetch_error", "x.error")).where("message is not null").select(*columns, "message")


def dedup_in_page(hits: DataFrame, keys: list[str]) -> DataFrame:
    w = W.Window.partitionBy(*keys, "url").orderBy("pos")
    return hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def anchors_native(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, href, name) of all anchors of a page, by expressions alone."""
    body = F.regexp_extract_all("html", F.lit(r"(?is)<a(?![0-9A-Za-z_])([^>]*)>(.*?)</a>"), 1)
    text = F.regexp_extract_all("html", F.lit(r"(?is)<a(?![0-9A-Za-z_])([^>]*)>(.*?)</a>"), 2)
    one = pages.select(*keys, F.posexplode(F.arrays_zip(body.alias("a"), text.alias("t"))).alias("pos", "h"))
    p = rx(r"(?i){b}href{s}*={s}*(?:\"([^\"]*)\"|'([^']*)')")
    href = F.concat(F.regexp_extract("h.a", p, 1), F.regexp_extract("h.a", p, 2))
    return one.select(*keys, "pos", href.alias("href"), collapse_ws(F.regexp_replace("h.t", "<[^>]*>", " ")).alias("name")).where("href <> ''")


def fallback_pages(hits: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The engine's pages for sites that allow it and whose own page gave no hit."""
    return pages.where(F.col("site_id").isin(FALLBACK_SITES)).join(hits.select(*keys).distinct(), keys, "left_anti")


def search_merge(hits: DataFrame, *, per_site: int = 5, total: int = 10, query: str | None = None) -> DataFrame:
    """Hits (site_rank, pos, url, name, source_name) in the order of sites and places: each URL once, at most
    ``per_site`` of a site and ``total`` of a query. ``query`` names the column of the query, if there
    are several.

    A URL counts as seen when it's taken, so one past a site's cap may still be taken from a later site.
    Of a site no more than its first ``per_site + total`` URLs can matter, as at most ``total`` were seen
    before: these go through one ordered fold a query, whatever a site lists. Hits without a URL are
    left out, an empty table gives an empty result.
    """
    by = [query] if query else []
    first = W.Window.partitionBy(*by, "site_rank", "url").orderBy("pos")
    site = W.Window.partitionBy(*by, "site_rank").orderBy("pos", "url")
    near = hits.where("url is not null").withColumn("rn", F.row_number().over(first)).where("rn = 1").withColumn("rn", F.row_number().over(site)).where(F.col("rn") <= per_site + total).drop("rn")
    rest = [c for c in hits.columns if c not in {*by, "site_rank", "pos", "url"}]
    row = F.struct("site_rank", "pos", "url", *rest)
    kind = near.select(row.alias("h")).schema["h"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{kind}>").alias("kept"), F.lit(None).cast(near.schema["site_rank"].dataType).alias("site"), F.lit(0).alias("n"))

    def take(acc, h):
        n = F.when(acc["site"] == h["site_rank"], acc["n"]).otherwise(F.lit(0))
        fits = (n < per_site) & (F.size(acc["kept"]) < total) & ~F.exists(acc["kept"], lambda k: k["url"] == h["url"])
        return F.struct(F.when(fits, F.concat(acc["kept"], F.array(h))).otherwise(acc["kept"]).alias("kept"), h["site_rank"].alias("site"), (n + fits.cast("int")).alias("n"))

    folded = near.groupBy(*by).agg(F.array_sort(F.collect_list(row), lambda a, b: _before(a, b)).alias("all"))
    kept = folded.select(*by, F.posexplode(F.aggregate("all", start, take, lambda acc: acc["kept"])).alias("rank", "_hit"))
    out = kept.select(*by, *[F.col("_hit").getField(c).alias(c) for c in ("site_rank", "pos", "url", *rest)], (F.col("rank") + 1).alias("rank"))
    return out.withColumn("name", js_trim(F.coalesce("name", fallback_name(F.col("url"))))).select(*[c for c in hits.columns], "rank")


def _before(a: Column, b: Column) -> Column:
    """The order of two hits: by site, place and URL."""
    result = F.lit(0)
    for c in ("url", "pos", "site_rank"):
        result = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(result)
    return result


def search_recipes(requests: DataFrame, fetch, *, per_site: int = 5, total: int = 10, query: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, errors) for ``requests``: a row for each site and query, with site_rank, site_id,
    source_name, allowed, search_url, engine and fallback_url. ``fetch`` gives a table (url and its
    other columns) html, resolved_url and fetch_error.

    A site whose page can't be fetched or parsed is an error of its own and stops no other. A site
    that may fall back on the engine does so where its own page was read and has no hits; what goes
    wrong with that is an error too.
    """
    keys = [*([query] if query else []), "site_rank", "site_id", "source_name"]
    # what is made of a pass's pages reads them parsed
    fetched = lambda rows: stash(parse_pages(fetch(rows).withColumnRenamed("resolved_url", "base_url")).drop("html"), "searched")
    first = fetched(requests.withColumn("url", F.col("search_url")))
    hits = parsed_hits(first.where("fetch_error is null"), keys)
    read = first.where("fetch_error is null and x.error is null and fallback_url is not null and not engine").select(*keys)
    # hits and pages are keyed by site and query alike
    again = requests.join(read.join(hits.select(*keys).distinct(), keys, "left_anti"), keys, "left_semi")
    second = fetched(again.withColumns({"url": F.col("fallback_url"), "engine": F.lit(True)}))
    more = parsed_hits(second.where("fetch_error is null"), keys)
    at = [*keys, "search_url"]
    failed = page_errors(second, at).withColumn("message", F.concat(F.lit("DuckDuckGo fallback failed: "), "message"))
    return search_merge(hits.unionByName(more), per_site=per_site, total=total, query=query), page_errors(first, at).unionByName(failed)
