"""Ingredient lines, steps, classes and numbers of a recipe for one page, in Python: what the column
expressions of ``ingredients``, ``steps`` and ``classify`` say, for pages that are in Python already.
A text that comes again is taken from the last ones."""

from __future__ import annotations

import math
import re
from functools import lru_cache

from ..functions.jscompat import END, WS_CHARS
from ..functions.rules import AISLE_RULES, AISLES, ALLERGEN_RULES, ALLERGENS, BATCH_PHRASES, FRACTIONS, LICENSE, NOT_VEGETARIAN, NUMBER_WORDS, SEASONAL, SITES, UNITS, UNKNOWN_LICENSE
from ..functions.text import fold, folding, phrase_words, variants
from .html import tidy

INF, LONG = float("inf"), 2**63 - 1
#: Texts up to this length are kept, so that the kept ones need little memory.
SHORT = 200


def _rx(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern as ``jscompat.rx`` takes it, with Java's ASCII digits."""
    return re.compile(pattern.replace("{s}", f"[{re.escape(WS_CHARS)}]").replace("{e}", END).replace(r"\d", "[0-9]"), flags)


def _kept(size: int):
    """A function of a text that keeps its last results, but not those of long texts."""

    def keep(f):
        cached = lru_cache(size)(f)
        return lambda s: cached(s) if s is None or len(s) <= SHORT else f(s)

    return keep


_I = re.I | re.A
_OTHER, _BEYOND = re.compile("[^a-z0-9]+"), re.compile("[^\0-\x7f]+")
_NUM = r"\d+(?:[.,]\d+)?"
_QUANTITY = _rx("(?:" + "|".join([_NUM + "{s}*(?:-|–|—|a|à){s}*" + _NUM + "{e}", r"\d+{s}+\d+/0*[1-9]\d*{e}", r"\d+/0*[1-9]\d*{e}", _NUM + "{e}", "(?:" + "|".join(NUMBER_WORDS) + "){e}"]) + ")", re.I)
_MEASURE = _rx("(?:kg|kilogrammes?|kilos?|g|gr|grammes?|ml|millilitres?|cl|centilitres?|l|litres?){e}", _I)
_MEASURES = {"k": ("kg", 1), "g": ("g", 1), "m": ("ml", 1), "c": ("ml", 10), "l": ("l", 1)}
_SPOON = _rx(r"(?:cs|c\.?{s}*a{s}*soupe|cuilleres?{s}*a{s}*soupe|cc|c\.?{s}*a{s}*cafe|cuilleres?{s}*a{s}*cafe|pincees?){e}")
_BULLET = _rx("[-*•]{s}+")
_CONNECTORS = _rx("(?:de{s}+)?(?:du{s}+)?(?:des{s}+)?(?:d['’]{s}*)?", _I)
_CONTAINER = _rx("(?:gousses?|tranches?|branches?|sachets?|boi(?:te|tes)s?){s}+(?:de|d'|d’|du|des){s}+", _I)
_PAREN = _rx(r"\({s}*[0-9.,]+{s}*(?:g|gr|kg|ml|cl|l){s}*\)", _I)
_FIRST, _LAST, _DIGITS = _rx(_NUM), _rx(_NUM + r"\Z"), _rx(r"\d+")
_RANGE = re.compile("[-–—aAàÀ]")


def trim(s: str) -> str:
    return s.strip(WS_CHARS)


def blank(s: str | None) -> bool:
    return s is None or not s.strip(WS_CHARS)


_FOLDING = folding()


def lowered(s: str) -> str:
    """text.ascii_lower for one string."""
    return s.lower() if s.isascii() else _BEYOND.sub(lambda m: m[0].translate(_FOLDING), s).lower()


# classes of an ingredient's name, as bits: aisles, allergens, in season, meat or fish

_RULES = [*(k for _, k in AISLE_RULES), *(k for _, k in ALLERGEN_RULES), SEASONAL, NOT_VEGETARIAN]
_AISLE_BITS = (1 << len(AISLE_RULES)) - 1
_SEASON, _MEAT = 1 << len(_RULES) - 2, 1 << len(_RULES) - 1
_WORDS: dict[str, int] = {}
_PHRASES: dict[str, list[tuple[list[set[str]], int]]] = {}  # by a form of their first word
for _i, _keywords in enumerate(_RULES):
    for _k in _keywords:
        _words = phrase_words(_k)
        _forms = [set(variants(w, len(_words) > 1 and j == len(_words) - 1)) for j, w in enumerate(_words)]
        for _f in _forms[0] if _forms else ():
            if len(_forms) == 1:
                _WORDS[_f] = _WORDS.get(_f, 0) | 1 << _i
            else:
                _PHRASES.setdefault(_f, []).append((_forms, 1 << _i))


def kinds_of(name: str) -> int:
    """The bits of all rules that a name matches."""
    tokens = _OTHER.sub(" ", lowered(name)).split()
    found = 0
    for i, t in enumerate(tokens):
        found |= _WORDS.get(t, 0)
        for forms, bit in _PHRASES.get(t, ()):
            if len(tokens) - i >= len(forms) and all(w in f for w, f in zip(tokens[i:], forms)):
                found |= bit
    return found


def aisle_of(kinds: int) -> str | None:
    first = kinds & _AISLE_BITS
    return AISLE_RULES[(first & -first).bit_length() - 1][0] if first else None


@lru_cache(1 << 12)
def allergens_of(kinds: int) -> list[str]:
    return [a for i, (a, _) in enumerate(ALLERGEN_RULES) if kinds >> len(AISLE_RULES) + i & 1]


# ingredient lines


def _value(w: str) -> float | None:
    if not "0" <= w[0] <= "9":
        return NUMBER_WORDS.get(w.lower())
    plain = lambda s: float(s.replace(",", "."))
    if "/" in w:
        left, _, below = w.partition("/")
        over = _DIGITS.findall(left)
        part = float(over[-1]) / float(below)
        return float(over[0]) + part if left != over[0] else part
    if _RANGE.search(w):
        return (plain(_FIRST.match(w)[0]) + plain(_LAST.search(w)[0])) / 2
    return plain(w)


def _unit(s: str) -> tuple[str, int, int] | None:
    """(unit, factor, length) of a leading unit."""
    if m := _MEASURE.match(s):
        return *_MEASURES[m[0][0].lower()], m.end()
    if s and (s[0] in "cCpP" or s[0] >= "\x80") and (m := _SPOON.match(lowered(s))):
        w = m[0]
        return "pincee" if w[0] == "p" else "cs" if w == "cs" or w.endswith("soupe") else "cc", 1, m.end()
    return None


def clean(line: str) -> str:
    return trim(line.replace("\xa0", " "))


@_kept(1 << 16)
def ingredient(line: str) -> tuple | None:
    """(name, quantity, unit, aisle, bits of its kinds, whether the schema takes it) of a line; None for a blank one."""
    o = clean(line)
    if not o:
        return None
    m = _BULLET.match(o)
    r = trim(o[m.end() :] if m else o)
    if not r.isascii():
        for glyph, text in FRACTIONS.items():
            r = r.replace(glyph, text)
    text, amount, unit = r, 1.0, "unit"
    if m := _QUANTITY.match(r):
        text = trim(r[m.end() :])
        amount = _value(m[0])
        if u := _unit(text):
            unit, factor, n = u
            text = trim(text[n:])
            amount = None if amount is None else amount * factor
    elif lowered(r) in ("sel", "poivre"):
        unit = "pincee"
    text = trim(text[_CONNECTORS.match(text).end() :])
    if m := _CONTAINER.match(text):
        text = text[m.end() :]
    name = trim(_PAREN.sub(" ", text) if "(" in text else text) or o
    name = name[:1].upper() + name[1:]
    kinds = kinds_of(name)
    aisle, amount = aisle_of(kinds), float(amount) if amount is not None and 0 < amount < INF else 1.0
    return name, amount, unit, aisle, kinds, not blank(name) and 0 < amount < INF and unit in UNITS and (aisle is None or aisle in AISLES)


# steps

_BATCH = re.compile("|".join(map(re.escape, map(fold, BATCH_PHRASES))))


def about_batches(text: str) -> bool:
    """Whether a phrase of classify.batch_friendly is part of a text; none goes beyond a line."""
    return _BATCH.search(lowered(text)) is not None


_known_batches = _kept(1 << 12)(about_batches)

_INDEX = _rx(r"{s}*(?:etape|step)?{s}*\d+{s}*[).:-]{s}*", _I)
_HOUR_MINUTE, _HOUR, _MINUTE = _rx(r"(\d+){s}*(?:h|heures?){s}*(\d+){s}*(?:min|minutes?)?", _I), _rx(r"(\d+){s}*(?:h|heures?){e}", _I), _rx(r"(\d+){s}*(?:min|minutes?){e}", _I)


def step_text(text: str) -> str:
    text = tidy(text)
    return trim(text[m.end() :]) if (m := _INDEX.match(text)) else text


def _minutes(s: str) -> int | None:
    if m := _HOUR_MINUTE.search(s):
        total = float(m[1]) * 60 + float(m[2])
    elif m := _HOUR.search(s):
        total = float(m[1]) * 60
    elif m := _MINUTE.search(s):
        total = float(m[1])
    else:
        return None
    return min(int(total), LONG) if 0 < total <= 2.0**63 else None


@_kept(1 << 15)
def step(text: str) -> tuple | None:
    """(description, minutes, whether it is about batches, whether the schema takes it) of a step's text; None for a blank one."""
    text = step_text(text)
    minutes = _minutes(text)
    return (text, minutes, about_batches(text), not blank(text) and (minutes is None or minutes > 0)) if text else None


# numbers

_ISO = _rx(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?\x85?\Z", _I)


@_kept(1 << 12)
def iso_minutes(s: str | None) -> float | None:
    if s is None or not (m := _ISO.match(trim(s))):
        return None
    d, h, mins, sec = (float(x or 0) for x in m.groups())
    total = d * 1440 + h * 60 + mins + float(LONG if sec / 60 > LONG else math.ceil(sec / 60))
    return total if total > 0 else None


def total_minutes(total: str | None, prep: str | None, cook: str | None) -> float:
    t = iso_minutes(total)
    if t is not None:
        return t
    p, c = iso_minutes(prep), iso_minutes(cook)
    return p + c if p is not None and c is not None else p if p is not None else c if c is not None else 30.0


def servings(text: str | None) -> float:
    n = float(m[0]) if text and (m := _DIGITS.search(text)) else 0.0
    return n if 0 < n < INF else 4.0


def clamp_int(x: float, low: int, high: int) -> int:
    return max(low, min(high, math.trunc(x))) if abs(x) < INF else low


# whole recipes

_TITLE = re.compile(r"<title(?![0-9A-Za-z_])[^>]*>(.*?)</title>", re.I | re.S | re.A)


def title_of(html: str) -> str:
    m = _TITLE.search(html)
    return trim(m[1]) if m else ""


@_kept(1 << 12)
def source_meta(host: str | None) -> tuple[str | None, str]:
    """(name, licence) of a host's site; an unknown host stands for itself."""
    h = (host or "").lower()
    name = next((n for _, n, suffix, _, _ in SITES if h == suffix or h.endswith("." + suffix)), None)
    return (host, UNKNOWN_LICENSE) if name is None else (name, LICENSE)


def vegetarian_diet(diets: list[str]) -> bool:
    return any("vegetariandiet" in d or "vegandiet" in d for d in map(lowered, diets))


def violations(r: dict) -> list[str]:
    """recipe.violations for one recipe."""
    url = r["source_url"]
    checks = (
        ("name", blank(r["name"])), ("description", r["description"] is None), ("max_prep_time", not 5 <= r["max_prep_time"] <= 300), ("base_servings", not 1 <= r["base_servings"] <= 20), ("allergens", not all(a in ALLERGENS for a in r["allergens"])),
        ("ingredients", len(r["ingredients"]) < 2 or not all(i[5] for i in r["ingredients"])),
        ("steps", len(r["steps"]) < 2 or not all(s[3] for s in r["steps"])),
        ("source_name", blank(r["source_name"])), ("source_url", url is None or not re.match("https?://[^/]", url)), ("source_license", blank(r["source_license"])), ("source_attribution", blank(r["source_attribution"])),
    )
    return [n for n, bad in checks if bad]


def first_error(fetch_error: str | None, page: dict, name: str, n_ingredients: int, n_steps: int) -> str | None:
    node = page["node"]
    if fetch_error is not None or page["error"] is not None:
        return fetch_error if fetch_error is not None else page["error"]
    if node is None:
        return "No recipe data found"
    if page["source_url"] is None and page["url_error"] is not None:
        return page["url_error"]
    return "Unable to derive recipe name" if name == "" else "Not enough ingredients extracted" if n_ingredients < 2 else "Not enough steps extracted" if n_steps < 2 else "Yield has no text" if node["yield_error"] else None


def error_alone(page: dict, html: str, fetch_error: str | None, over: tuple[str | None, str | None, str | None]) -> str | None:
    """The error of ``whole``, from what errors depend on: names, quantities, units, classes and minutes are within
    the schema whatever they are."""
    n = page["node"] or {}
    name = n.get("name")
    name = trim(name) if name is not None else title_of(html)
    error = first_error(fetch_error, page, name, sum(clean(x) != "" for x in n.get("lines") or ()), sum(step_text(x) != "" for x in n.get("step_texts") or ()))
    if error is None:
        site, licence = source_meta(page["host"])
        said = (("source_name", over[0] if over[0] is not None else site), ("source_license", over[1] if over[1] is not None else licence), ("source_attribution", over[2] if over[2] is not None else site))
        if bad := [k for k, v in said if blank(v)]:
            error = "Invalid: " + ", ".join(bad)
    return error


def whole(page: dict, html: str, fetch_error: str | None, over: tuple[str | None, str | None, str | None]) -> dict:
    """The recipe's fields and its error, from what ``html.read_page`` found."""
    n = page["node"] or {}
    name = n.get("name")
    name, description = trim(name) if name is not None else title_of(html), trim(n.get("description") or "")
    lines, texts = n.get("lines"), n.get("step_texts")
    ingredients = None if lines is None else [i for x in lines if (i := ingredient(x))]
    steps = None if texts is None else [s for x in texts if (s := step(x))]
    kinds = 0
    for i in ingredients or ():
        kinds |= i[4]
    said = vegetarian_diet(n.get("diets") or [])
    known = ingredients is not None
    site, licence = source_meta(page["host"])
    r = {
        "name": name, "description": description, "vegetarian": said or (not kinds & _MEAT if known else None), "max_prep_time": clamp_int(total_minutes(n.get("total_time"), n.get("prep_time"), n.get("cook_time")), 5, 300),
        "is_seasonal": bool(kinds & _SEASON) if known else None, "batch_friendly": about_batches(name) or _known_batches(description) or any(s[2] for s in steps or ()), "base_servings": clamp_int(servings(n.get("yield_text")), 1, 20), "allergens": allergens_of(kinds),
        "ingredients": ingredients, "steps": steps, "source_name": over[0] if over[0] is not None else site, "source_url": page["source_url"], "source_license": over[1] if over[1] is not None else licence, "source_attribution": over[2] if over[2] is not None else site,
    }
    error = first_error(fetch_error, page, name, len(ingredients or ()), len(steps or ()))
    if error is None and (bad := violations(r)):
        error = "Invalid: " + ", ".join(bad)
    return r | {"error": error}
