"""Instructions: splitting, numbering and minutes as column expressions; flattening as Python."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jscompat import WS_CHARS, collapse_ws, js_trim, let, rx

HOUR_MINUTE = rx(r"(?i)(\d+){s}*(?:h|heures?){s}*(\d+){s}*(?:min|minutes?)?")
HOUR = rx(r"(?i)(\d+){s}*(?:h|heures?){e}")
MINUTE = rx(r"(?i)(\d+){s}*(?:min|minutes?){e}")


def steps_split(c: Column) -> Column:
    """An instruction text's lines if two or more aren't blank, else its sentences if two or more, else itself."""
    full = lambda a: F.filter(a, lambda x: x != "")

    def parts(raw: Column) -> Column:
        lines = full(F.transform(F.split(raw, "\n+"), collapse_ws))
        one = collapse_ws(raw)
        sentences = full(F.transform(F.split(one, rx("[.;](?:{s}+|$)")), js_trim))
        return let(lines, lambda ls: F.when(F.size(ls) >= 2, ls).otherwise(let(sentences, lambda ss: F.when(F.size(ss) >= 2, ss).otherwise(F.array(one)))))

    raw = js_trim(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    return let(raw, lambda r: F.when((r == "") | r.isNull(), F.array().cast("array<string>")).otherwise(parts(r)))


def step_strip_index(c: Column) -> Column:
    return js_trim(F.regexp_replace(c, rx(r"(?i)^{s}*(?:etape|step)?{s}*\d+{s}*[).:-]{s}*"), ""))


def step_minutes(c: Column) -> Column:
    """Minutes mentioned: hours and minutes, hours, or minutes; the first form found decides."""
    n = lambda p, i: F.regexp_extract(c, p, i).try_cast("double")
    has = lambda p: F.regexp_extract(c, p, 0) != ""
    total = F.when(has(HOUR_MINUTE), n(HOUR_MINUTE, 1) * 60 + n(HOUR_MINUTE, 2)).when(has(HOUR), n(HOUR, 1) * 60).when(has(MINUTE), n(MINUTE, 1))
    return F.when(total > 0, total)


def steps_normalize(texts: Column) -> Column:
    """array<struct(description, minutes)> from raw step texts; blank ones go."""
    kept = F.filter(F.transform(texts, lambda t: step_strip_index(collapse_ws(t))), lambda t: t != "")
    return F.transform(kept, lambda t: F.struct(t.alias("description"), step_minutes(t).try_cast("bigint").alias("minutes")))


def split_text(s: str) -> list[str]:
    """steps_split for one string, for texts met while flattening."""
    return list(_last_split(s)) if len(s) <= 500 else _split_text(s)


def _split_text(s: str) -> list[str]:
    raw = s.replace("\r\n", "\n").replace("\r", "\n").strip(WS_CHARS)
    if not raw:
        return []
    tidy = lambda x: re.sub(f"[{re.escape(WS_CHARS)}]+", " ", x).strip(WS_CHARS)
    lines = [x for x in map(tidy, re.split("\n+", raw)) if x]
    if len(lines) >= 2:
        return lines
    parts = [x for x in (p.strip(WS_CHARS) for p in re.split(r"[.;](?: +|$)", tidy(raw))) if x]
    return parts if len(parts) >= 2 else [tidy(raw)]


_last_split = lru_cache(1 << 13)(_split_text)


def flatten(value) -> list[str]:
    """Step texts of a JSON value: strings are split, arrays joined; of an object its text, its
    items, its steps, or, of a plain HowToStep, its name."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            out += split_text(v)
        elif isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            kind = v.get("@type")
            if isinstance(v.get("text"), str):
                out.append(v["text"])
            elif truthy(v.get("itemListElement")):
                todo.append(v["itemListElement"])
            elif truthy(v.get("steps")):
                todo.append(v["steps"])
            elif isinstance(v.get("name"), str) and (kind == "HowToStep" or isinstance(kind, list) and "HowToStep" in kind):
                out.append(v["name"])
    return out


def truthy(v) -> bool:
    """JavaScript's notion: empty arrays and objects count as true."""
    return isinstance(v, (list, dict)) or bool(v) and v == v
