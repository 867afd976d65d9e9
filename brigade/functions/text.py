"""Folding, tokens, keyword matching, entities and tags, as columns."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .jscompat import let


@lru_cache(maxsize=1)
def _marks() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII letter or a ligature plus marks, and those letters."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if not "̀" <= c <= "ͯ"]
        if len(parts) == 1 and parts[0] != chr(code) and (parts[0].isascii() or parts[0] in "ÆæŒœ"):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def strip_diacritics(c: Column) -> Column:
    """Letters without their marks; translate drops what has no counterpart, here marks of their own."""
    source, target = _marks()
    return F.translate(c, source + "".join(map(chr, range(0x300, 0x370))), target)


def folding() -> dict[int, str | None]:
    """For str.translate: letters without their marks, ligatures written out."""
    source, target = _marks()
    table = dict.fromkeys(range(0x300, 0x370)) | {ord(a): b for a, b in zip(source, target)}
    ligatures = {"Œ": "oe", "œ": "oe", "Æ": "ae", "æ": "ae"}
    return {k: ligatures.get(v, v) for k, v in table.items()} | {ord(k): v for k, v in ligatures.items()}


def ascii_lower(c: Column) -> Column:
    """Marks off, ligatures written out, lower case; other letters stay."""
    c = strip_diacritics(c)
    for glyph, text in (("Œ", "oe"), ("œ", "oe"), ("Æ", "ae"), ("æ", "ae")):
        c = F.replace(c, F.lit(glyph), F.lit(text))
    return F.lower(c)


def tokens_text(c: Column) -> Column:
    """The tokens of a text with one space between."""
    return F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", " "))


def tokenize(c: Column) -> Column:
    return F.filter(F.split(tokens_text(c), " "), lambda t: t != "")


def fold(s: str) -> str:
    """ascii_lower for the driver's constants."""
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not "̀" <= c <= "ͯ")
    return s.replace("œ", "oe").replace("Œ", "oe").replace("æ", "ae").replace("Æ", "ae").lower()


def variants(word: str, last: bool) -> list[str]:
    """A token's accepted forms: plural s or x added, or its own taken off; a phrase's last word takes both."""
    forms = [word, word + "s", word + "x"]
    if word[-1] in "sx":
        forms.append(word[:-1])
    if last:
        forms += [word + a + b for a in "sx" for b in "sx"]
    return list(dict.fromkeys(forms))


def phrase_words(phrase: str) -> list[str]:
    """A keyword's words, folded."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in fold(phrase)).split()


def keyword_regex(keywords: list[str]) -> str:
    """One pattern over space-joined tokens for any of the keywords; plain enough for RE2 as well."""
    parts = []
    for k in keywords:
        words = phrase_words(k)
        if words:
            parts.append(" ".join("(?:" + "|".join(variants(w, len(words) > 1 and i == len(words) - 1)) + ")" for i, w in enumerate(words)))
    return "(?:^| )(?:" + "|".join(parts) + ")(?: |$)"


def matches_keywords(c: Column, keywords: list[str]) -> Column:
    return tokens_text(c).rlike(keyword_regex(keywords))


def decode_numeric(s: str) -> str:
    """Numeric entities of one string; a number beyond Unicode is an error, as in a browser engine's fromCodePoint."""
    import re

    def char(n: int) -> str:
        if n > 0x10FFFF:
            raise ValueError(f"Invalid code point {n}")
        return chr(n)

    s = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: char(int(m[1], 16)), s, flags=re.I)
    return re.sub(r"&#([0-9]+);", lambda m: char(int(m[1])), s)


def decode_text(s: str) -> str:
    """Entities of one string: hexadecimal, decimal, then the five names, & last."""
    import re

    if "&" not in s:
        return s
    s = decode_numeric(s)
    for name, char in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        s = re.sub(f"&{name};", lambda _, c=char: c, s, flags=re.I)
    return s


@F.pandas_udf(T.StringType())
def _numeric(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else _try(x))


def _try(x: str):
    try:
        return decode_numeric(x)
    except (ValueError, OverflowError):
        return None


def decode_names(c: Column) -> Column:
    for name, char in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = F.regexp_replace(c, f"(?i)&{name};", char)
    return c


def decode_entities(c: Column) -> Column:
    """Entities decoded; null where a number is beyond Unicode. Only texts with numbers go to Python."""
    return decode_names(F.when(c.contains("&#"), _numeric(F.when(c.contains("&#"), c))).otherwise(c))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", " ")


def capitalize_first(c: Column) -> Column:
    """The first letter in upper case, the rest as it is."""
    return let(c, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))
