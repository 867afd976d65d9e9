"""Host names in any script, as URLs write them: the mapping and the checks of UTS 46 (non-transitional,
without the hyphen, length and letter-digit rules), from the character properties that Python carries.

The mapping isn't kept as a table: it follows from case folding, compatibility forms and the
characters that are ignored by default, as the standard derives it.
"""

from __future__ import annotations

import re
import unicodedata as U
from functools import lru_cache

# Fixed values of the standard.
_KEPT = "\u00df\u03c2\u200c\u200d"  # sharp s, final sigma and the two joiners stand as they are
_IGNORED = re.compile("[\u00ad\u034f\u180b-\u180d\u180f\u200b\u2060\u2064\ufe00-\ufe0f\ufeff\U0001bca0-\U0001bca3\U000e0100-\U000e01ef]")
_NEVER = re.compile("[\u061c\u115f\u1160\u17b4\u17b5\u180e\u200e\u200f\u202a-\u202e\u2061-\u2063\u2066-\u206f\u2ff0-\u2fff\u3164\uffa0\ufff0-\uffff\U0001d173-\U0001d17a\U000e0000-\U000e00ff]")
_SYRIAC_RIGHT = ("ALAPH", "DALATH", "DOTLESS DALATH RISH", "HE", "WAW", "ZAIN", "SADHE", "RISH", "TAW")


class HostError(ValueError):
    """A host name that the rules reject."""


@lru_cache(maxsize=1 << 14)
def _mapped(c: str) -> str:
    """What one character becomes; HostError where it's not allowed."""
    if c in _KEPT or c.isascii():
        return c.lower()
    if c == "\u1e9e":
        return "\u00df"
    if c in "\u3002\uff0e\uff61":
        return "."
    if _IGNORED.match(c):
        return ""
    if _NEVER.match(c):
        raise HostError("Invalid URL")
    out = U.normalize("NFKC", U.normalize("NFKC", U.normalize("NFD", c).casefold()).casefold())
    if out == c and U.category(c)[0] in "CZ":
        raise HostError("Invalid URL")
    return _IGNORED.sub("", out)


def _valid(c: str) -> bool:
    try:
        return c in _KEPT or _mapped(c) == c
    except HostError:
        return False


@lru_cache(maxsize=1 << 12)
def _joining(c: str) -> str:
    """How a letter joins its neighbours: D on both sides, R to the right only, T seen through, U not.

    Arabic letters join as their presentation forms say, or those of the letter they are made from.
    """
    if c in "\u200c\u200d":
        return "U"
    if U.category(c) in ("Mn", "Me", "Cf"):
        return "T"
    name = U.name(c, "")
    if name.startswith("ARABIC LETTER "):
        base = name.partition(" WITH ")[0]
        for form, kind in ((" INITIAL FORM", "D"), (" FINAL FORM", "R")):
            for n in (name, base):
                try:
                    U.lookup(n + form)
                    return kind
                except KeyError:
                    pass
        return "U"
    if name.startswith("SYRIAC LETTER "):
        return "R" if name[14:] in _SYRIAC_RIGHT else "D"
    return "D" if name.startswith(("NKO LETTER ", "MONGOLIAN LETTER ", "ADLAM SMALL LETTER ")) else "U"


def _joiners_ok(label: str) -> bool:
    """A joiner follows a virama; the non-joiner may also stand between letters that would join."""
    for i, c in enumerate(label):
        if c not in "\u200c\u200d" or (i and U.combining(label[i - 1]) == 9):
            continue
        if c == "\u200d":
            return False
        before = next((t for t in map(_joining, reversed(label[:i])) if t != "T"), "U")
        after = next((t for t in map(_joining, label[i + 1 :]) if t != "T"), "U")
        if before != "D" or after not in "RD":
            return False
    return True


def _bidi_ok(label: str) -> bool:
    """The rule of RFC 5893 for one label of a name that holds right-to-left characters."""
    kinds = [U.bidirectional(c) for c in label]
    while kinds and kinds[-1] == "NSM":
        kinds.pop()
    every = set(kinds)
    neutral = {"EN", "ES", "CS", "ET", "ON", "BN", "NSM"}
    if not kinds:
        return not label
    if kinds[0] in ("R", "AL"):
        return every <= neutral | {"R", "AL", "AN"} and kinds[-1] in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= every
    return kinds[0] == "L" and every <= neutral | {"L"} and kinds[-1] in ("L", "EN")


def _decoded(label: str) -> str:
    """The characters of a label; those of an ``xn--`` label must be what it would have been made from."""
    if not label.startswith("xn--"):
        return label
    try:
        out = label[4:].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, OverflowError):
        raise HostError("Invalid URL") from None
    if not out or out.isascii() or U.normalize("NFC", out) != out or "." in out or out.startswith("xn--"):
        raise HostError("Invalid URL")
    return out


@lru_cache(maxsize=1 << 14)
def to_ascii(host: str) -> str:
    """A host name in its ASCII form. HostError where a character, a punycode label, a leading mark,
    a joiner or the order of right-to-left text isn't allowed; empty labels stay."""
    name = host.lower()
    if name.isascii() and not any(x.startswith("xn--") for x in name.split(".")):
        return name
    labels = [_decoded(x) for x in U.normalize("NFC", "".join(map(_mapped, host))).split(".")]
    rtl = any(U.bidirectional(c) in ("R", "AL", "AN") for x in labels for c in x)
    for x in labels:
        if not all(map(_valid, x)) or (x and U.category(x[0])[0] == "M") or not _joiners_ok(x) or (rtl and not _bidi_ok(x)):
            raise HostError("Invalid URL")
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)


def to_unicode(host: str) -> str:
    """A normalised host name as it is read; a label that isn't valid punycode stays as it is."""
    out = []
    for x in host.split("."):
        try:
            out.append(_decoded(x))
        except HostError:
            out.append(x)
    return ".".join(out)
