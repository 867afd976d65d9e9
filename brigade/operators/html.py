"""Pages: JSON-LD, microdata and head data. Scanning is Python on Arrow batches, once for each page."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.jscompat import WS, WS_CHARS, js_trim, rx, struct_type
from ..functions.text import decode_text
from ..functions.urls import host_of, resolve, url_parts
from .steps import flatten, truthy
from .tree import Node, Tree

_S = f"[{re.escape(WS_CHARS)}]"
_BLANKS = re.compile(f"{_S}+")
#: What makes tidying more than trimming: blanks that aren't single spaces.
_UNTIDY = re.compile(f" {_S}|[{re.escape(WS_CHARS.replace(' ', ''))}]")
_NS = f"[^{re.escape(WS_CHARS)}>]"
#: A script with a type; the last type= of its tag counts.
_SCRIPT = re.compile(rf"<script\b[^>]*\btype{_S}*={_S}*(?:\"([^\"]*)\"|'([^']*)'|({_NS}+))[^>]*>(.*?)</script>", re.I | re.S | re.A)
_LINK, _META = (re.compile(rf"<{t}(?![0-9A-Za-z_])[^>]*>", re.I | re.A) for t in ("link", "meta"))
_ATTRS = {n: re.compile(rf"{n}{_S}*={_S}*(?:\"([^\"]*)\"|'([^']*)'|([^\"'>{re.escape(WS_CHARS)}]+))", re.I | re.A) for n in ("rel", "href", "property", "name", "content")}
_TEXT_KEYS = ["name", "description", "totalTime", "prepTime", "cookTime", "recipeYield", "suitableForDiet", "url"]


def _attr(tag: str, name: str) -> str | None:
    """html_attr for one tag."""
    m = next(_tags(_ATTRS[name], name, tag, tag.lower()), None)
    return m and _trim(next((g for g in m.groups() if g is not None), "")) or None


def _trim(s: str) -> str:
    return s.strip(WS_CHARS)


def tidy(s: str) -> str:
    return _trim(_BLANKS.sub(" ", s) if _UNTIDY.search(s) else s)


def _tags(pattern: re.Pattern, begin: str, html: str, low: str):
    """``pattern.finditer(html)`` of a pattern that begins with ``begin`` in any case; ``low`` is the page in lower
    case, whose places are the page's where no letter has grown."""
    if len(low) != len(html):
        yield from pattern.finditer(html)
        return
    i = low.find(begin)
    while i >= 0:
        m = pattern.match(html, i)
        if m:
            yield m
        i = low.find(begin, m.end() if m else i + 1)


def _is_jsonld(kind: str) -> bool:
    return _trim(_trim(decode_text(_trim(kind))).lower().partition(";")[0]) == "application/ld+json"


_kept_kind = lru_cache(1 << 10)(_is_jsonld)


def jsonld_texts(html: str, low: str | None = None) -> list[str]:
    """The bodies of a page's ld+json scripts, without comment marks, blank ones left out."""
    out = []
    for m in _tags(_SCRIPT, "<script", html, html.lower() if low is None else low):
        kind = next((g for g in m.groups()[:3] if g is not None), "")
        if not (_kept_kind if len(kind) < 100 else _is_jsonld)(kind):
            continue
        body = _trim(m[4])
        if body.startswith("<!--"):
            body = body[4:].lstrip(WS_CHARS)
        if body.endswith("-->"):
            body = body[:-3].rstrip(WS_CHARS)
        if body := _trim(body):
            out.append(body)
    return out


def _ordered(pairs):
    """An object's keys in JavaScript's order: array indexes ascending, then as they came."""
    d = dict(pairs)
    index = [k for k in d if "0" <= k[:1] <= "9" and re.fullmatch("0|[1-9][0-9]{0,9}", k) and int(k) < 2**32 - 1]
    if index:
        index.sort(key=int)
        first = {k: d[k] for k in index}
        return first | {k: v for k, v in d.items() if k not in first}
    return d


def _refuse(name):
    raise ValueError(name)


_STRICT, _UNORDERED = json.JSONDecoder(object_pairs_hook=_ordered, parse_constant=_refuse), json.JSONDecoder(parse_constant=_refuse)
#: What keys that are array indexes look like, or may be hidden in.
_INDEXED = re.compile(r'"[0-9]+"[ \t\n\r]*:|\\u')


def parse_json(text: str):
    """Strict JSON, or None."""
    try:
        return None if text.startswith("\ufeff") else (_STRICT if _INDEXED.search(text) else _UNORDERED).decode(text)
    except (ValueError, RecursionError):
        return None


def walk(root):
    """Every object below a value, parents first, in document order."""
    todo = [root]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            yield v
            todo += reversed(list(v.values()))


def has_type(obj: dict, name: str) -> bool:
    kinds = obj.get("@type")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    for k in kinds:
        if isinstance(k, str):
            k = _trim(k)
            if ((k.rpartition("/")[2] if "/" in k else k).rpartition(":")[2] or k) == name:
                return True
    return False


def first_recipe(html: str, low: str | None = None) -> dict | None:
    for text in jsonld_texts(html, low):
        for obj in walk(parse_json(text)):
            if has_type(obj, "Recipe"):
                return obj
    return None


def _value(n: Node) -> str:
    """An element's value: its first attribute of these that isn't empty, or its text."""
    a = n.attrs
    return tidy(a.get("content") or a.get("value") or a.get("href") or a.get("src") or n.text())


#: Node keys and the properties looked for, in order.
_PROPS = [("name", ["name"]), ("description", ["description"]), ("totalTime", ["totalTime"]), ("prepTime", ["prepTime"]), ("cookTime", ["cookTime"]), ("recipeYield", ["recipeYield", "yield"]), ("suitableForDiet", ["suitableForDiet"]), ("url", ["url"])]


def microdata_node(html: str, low: str | None = None) -> dict | None:
    """The first schema.org recipe element's properties; None if there are none."""
    if "itemscope" not in (html.lower() if low is None else low):
        return None
    for root in Tree(html).root.below():
        kind = root.attrs.get("itemtype", "").lower()
        if "itemscope" in root.attrs and "schema.org" in kind and "recipe" in kind:
            break
    else:
        return None
    named = [(p, n) for n in root.below() if (p := n.attrs.get("itemprop"))]
    first: dict[str, Node] = {}
    for p, n in named:
        first.setdefault(p, n)
    node = {}
    for key, props in _PROPS:
        value = next((v for p in props if p in first and (v := _value(first[p]))), None)
        if value:
            node[key] = value
    lines = [v for p, n in named if p in ("recipeIngredient", "ingredients") and (v := _value(n))]
    steps = []
    for p, n in named:
        if p in ("recipeInstructions", "instructions"):
            items = [t for x in n.below() if x.tag == "li" and (t := tidy(x.text()))]
            steps += items if len(items) >= 2 else [v] if (v := _value(n)) else []
    if lines:
        node["recipeIngredient"] = lines
    if steps:
        node["recipeInstructions"] = steps
    return node or None


def merge_nodes(a: dict | None, b: dict | None) -> dict | None:
    """JSON-LD first, microdata for what it lacks; one alone stays as it is."""
    if a is None or b is None:
        return a if b is None else b
    out = b | a
    for k in _TEXT_KEYS:
        chosen = next((t for x in (a.get(k), b.get(k)) if isinstance(x, str) and (t := _trim(x))), None)
        if chosen:
            out[k] = chosen
    as_list = lambda x: x if isinstance(x, list) else [x] if isinstance(x, str) and _trim(x) else []
    one, two = as_list(a.get("recipeIngredient")), as_list(b.get("recipeIngredient"))
    out["recipeIngredient"] = one if len(one) >= 2 else two if len(two) >= 2 else one or two
    x, y = a.get("recipeInstructions"), b.get("recipeInstructions")
    lists = [v if isinstance(v, list) else [] for v in (x, y)]
    texts = [v if isinstance(v, str) and _trim(v) else "" for v in (x, y)]
    long = [v for v in lists if len(v) >= 2]
    out["recipeInstructions"] = long[0] if long else lists[0] or texts[0] or lists[1] or texts[1] or []
    return out


def _diets(v) -> list[str]:
    one = lambda x: x if isinstance(x, str) else x.get("@id") if isinstance(x, dict) else None
    return [d for x in (v if isinstance(v, list) else [v]) if isinstance(d := one(x), str)]


NODE = "name string, description string, total_time string, prep_time string, cook_time string, yield_text string, yield_error boolean, diets array<string>, lines array<string>, step_texts array<string>, main_entity string, node_url string"

NODE_FIELDS = [f.split(" ")[0] for f in NODE.split(", ")]


def typed(node: dict) -> dict:
    """What later stages read of a node, with JavaScript's notions of missing values."""
    text = lambda k: v if isinstance(v := node.get(k), str) else None
    y = node["recipeYield"] if node.get("recipeYield") is not None else node.get("yield")
    strings = [x for x in y if isinstance(x, str)] if isinstance(y, list) else []
    lines = node.get("recipeIngredient")
    main = node.get("mainEntityOfPage")
    return {
        "name": text("name"), "description": text("description"), "total_time": text("totalTime"), "prep_time": text("prepTime"), "cook_time": text("cookTime"),
        "yield_text": y if isinstance(y, str) else strings[0] if strings else None, "yield_error": isinstance(y, list) and not strings, "diets": _diets(node.get("suitableForDiet")),
        "lines": [lines] if isinstance(lines, str) and lines else [x for x in lines if isinstance(x, str)] if isinstance(lines, list) else [],
        "step_texts": flatten(node.get("recipeInstructions")) if truthy(node.get("recipeInstructions")) else [],
        "main_entity": main if isinstance(main, str) else main.get("@id") if isinstance(main, dict) and isinstance(main.get("@id"), str) else None, "node_url": text("url"),
    }


def page_node(html: str | None, jsonld: bool = True, micro: bool = True, low: str | None = None) -> dict:
    """(node, error) of a page: its merged recipe, typed; an error instead of one that can't be read."""
    html = html or ""
    low = html.lower() if low is None else low
    try:
        node = merge_nodes(first_recipe(html, low) if jsonld else None, microdata_node(html, low) if micro else None)
        return {"node": typed(node) if node is not None else None, "error": None}
    except (ValueError, OverflowError, RecursionError) as e:
        return {"node": None, "error": f"Unreadable page: {e}"}


def _fields(more: str = "") -> T.StructType:
    return T.StructType([T.StructField("node", struct_type(NODE)), T.StructField("error", T.StringType()), *(struct_type(more).fields if more else [])])


def _rows(rows: list[dict], kind: T.StructType) -> pa.Array:
    return pa.array(rows, to_arrow_type(kind))


@F.arrow_udf(_fields())
def extract_node(html: pa.Array) -> pa.Array:
    """The merged recipe of each page."""
    return _rows([page_node(h) for h in html.to_pylist()], _fields())


@F.arrow_udf(_fields())
def extract_jsonld(html: pa.Array) -> pa.Array:
    """The JSON-LD recipe of each page alone."""
    return _rows([page_node(h, micro=False) for h in html.to_pylist()], _fields())


@F.arrow_udf(_fields())
def extract_microdata(html: pa.Array) -> pa.Array:
    """The microdata recipe of each page alone."""
    return _rows([page_node(h, jsonld=False) for h in html.to_pylist()], _fields())


def canonical_of(html: str, low: str | None = None) -> str | None:
    """canonical_url for one page."""
    low = html.lower() if low is None else low
    found = None
    if "canonical" in low:
        found = next((u for t in _tags(_LINK, "<link", html, low) if (_attr(t[0], "rel") or "").lower() == "canonical" and (u := _attr(t[0], "href"))), None)
    if found is None and "og:url" in low:
        found = next((u for t in _tags(_META, "<meta", html, low) if (_attr(t[0], "property") or _attr(t[0], "name") or "").lower() == "og:url" and (u := _attr(t[0], "content"))), None)
    try:
        return None if found is None else decode_text(found)
    except (ValueError, OverflowError):
        return None


def source_of(url: str | None, canonical: str | None, node: dict | None) -> tuple[str | None, str | None, str | None]:
    """(source URL, its host, error): the first of the page's own URLs that resolves against the one asked for, or that one."""
    base, _, error = url_parts(url)
    if base is None:
        return None, None, error
    node = node or {}
    source = next((u for c in (canonical, node.get("main_entity"), node.get("node_url")) if c and (u := resolve(c, base))), base)
    return source, host_of(source), None


_PAGE = "canonical string, source_url string, host string, url_error string"


def read_page(html: str | None, url: str | None) -> dict:
    """All that needs Python of one page: its merged recipe and its URLs."""
    html = html or ""
    low = html.lower()
    r = page_node(html, low=low)
    c = canonical_of(html, low)
    source, host, error = source_of(url, c, r["node"])
    return r | {"canonical": c, "source_url": source, "host": host, "url_error": error}


@F.arrow_udf(_fields(_PAGE))
def extract_page(html: pa.Array, url: pa.Array) -> pa.Array:
    """All that needs Python of each page, in one pass: its merged recipe and its URLs."""
    return _rows([read_page(h, u) for h, u in zip(html.to_pylist(), url.to_pylist())], _fields(_PAGE))


@F.pandas_udf(T.StringType())
def merged_json(html: pd.Series) -> pd.Series:
    """The merged node of each page as JSON."""
    nodes = [merge_nodes(first_recipe(h or ""), microdata_node(h or "")) for h in html]
    return pd.Series([None if n is None else json.dumps(n, ensure_ascii=False) for n in nodes], dtype=object)


def html_attr(tag: Column, name: str) -> Column:
    """The first value after ``name=`` anywhere in a tag, trimmed; null if blank."""
    p = rx(rf"(?i){name}{{s}}*={{s}}*(?:\"([^\"]*)\"|'([^']*)'|([^\"'>") .replace("{{", "{").replace("}}", "}") + WS + "]+))"
    whole = F.regexp_extract(tag, p, 0)
    value = F.concat(*[F.regexp_extract(tag, p, i) for i in (1, 2, 3)])
    return F.when(whole != "", F.nullif(js_trim(value), F.lit("")))


def html_title(html: Column) -> Column:
    return F.nullif(js_trim(F.regexp_extract(html, r"(?is)<title(?![0-9A-Za-z_])[^>]*>(.*?)</title>", 1)), F.lit(""))


@F.arrow_udf(T.StringType())
def canonical_url(html: pa.Array) -> pa.Array:
    """The first canonical link's target, else the og:url; entities decoded."""
    return pa.array([None if h is None else canonical_of(h) for h in html.to_pylist()], pa.string())


__all__ = ["canonical_url", "extract_node", "html_attr", "html_title", "jsonld_texts", "merge_nodes", "merged_json", "microdata_node", "page_node"]
