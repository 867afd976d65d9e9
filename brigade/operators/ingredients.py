"""Ingredient lines: quantity, unit and name as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jscompat import js_trim, let, number, rx
from ..functions.rules import FRACTIONS, NUMBER_WORDS
from ..functions.text import ascii_lower, capitalize_first

_NUM = r"\d+(?:[.,]\d+)?"
#: The forms of a quantity, the first that fits counts: a range, a mixed number, a fraction, a number, a word.
QUANTITY = rx("(?iu)^(?:" + "|".join([_NUM + "{s}*(?:-|–|—|a|à){s}*" + _NUM + "{e}", r"\d+{s}+\d+/0*[1-9]\d*{e}", r"\d+/0*[1-9]\d*{e}", _NUM + "{e}", "(?:" + "|".join(NUMBER_WORDS) + "){e}"]) + ")")

#: Measures, told apart by their first letter: unit and factor.
MEASURE = rx("(?i)^(?:kg|kilogrammes?|kilos?|g|gr|grammes?|ml|millilitres?|cl|centilitres?|l|litres?){e}")
MEASURES = {"k": ("kg", 1), "g": ("g", 1), "m": ("ml", 1), "c": ("ml", 10), "l": ("l", 1)}
#: Spoons and pinches, looked for in the folded text.
SPOON = rx(r"^(?:cs|c\.?{s}*a{s}*soupe|cuilleres?{s}*a{s}*soupe|cc|c\.?{s}*a{s}*cafe|cuilleres?{s}*a{s}*cafe|pincees?){e}")


def ing_fractions(c: Column) -> Column:
    for glyph, text in FRACTIONS.items():
        c = F.replace(c, F.lit(glyph), F.lit(text))
    return c


def _value(w: Column) -> Column:
    """The number that a quantity's text stands for."""
    plain = lambda c: number(F.replace(c, F.lit(","), F.lit(".")))
    first, last = F.regexp_extract(w, "^" + _NUM, 0), F.regexp_extract(w, _NUM + "$", 0)
    left = F.substring_index(w, "/", 1)
    part = F.try_divide(number(F.regexp_extract(left, r"\d+$", 0)), number(F.substring_index(w, "/", -1)))
    mixed = F.when(left.rlike("[^0-9]"), number(F.regexp_extract(left, r"^\d+", 0)) + part).otherwise(part)
    words = F.create_map(*[F.lit(x) for w_, v in NUMBER_WORDS.items() for x in (w_, float(v))])
    ranged = F.when(w.rlike("[-–—aAàÀ]"), (plain(first) + plain(last)) / 2).otherwise(plain(w))
    return F.when(w.rlike("^[0-9]"), F.when(w.contains("/"), mixed).otherwise(ranged)).otherwise(F.try_element_at(words, F.lower(w)))


def ing_quantity(s: Column) -> Column:
    """struct(q, n): the leading quantity and its length; null if there's none. The first rule counts."""
    return let(F.regexp_extract(s, QUANTITY, 0), lambda w: F.when(w != "", F.struct(_value(w).cast("double").alias("q"), F.length(w).alias("n"))))


def ing_unit(s: Column) -> Column:
    """struct(unit, factor, n): the leading unit; null if there's none. Spoons and pinches are looked
    for in the folded text, and its length is taken off the text as it stands."""
    found = lambda unit, factor, w: F.struct(unit.alias("unit"), factor.alias("factor"), F.length(w).alias("n"))

    def measure(w: Column) -> Column:
        letter = F.lower(F.substring(w, 1, 1))
        unit, factor = (F.coalesce(*[F.when(letter == k, F.lit(v[i])) for k, v in MEASURES.items()]) for i in (0, 1))
        return F.when(w != "", found(unit, factor, w)).when(s.rlike(r"^[cCpP\x{80}-\x{10FFFF}]"), let(F.regexp_extract(ascii_lower(s), SPOON, 0), spoon))

    def spoon(w: Column) -> Column:
        unit = F.when(w.startswith("p"), "pincee").when((w == "cs") | w.endswith("soupe"), "cs").otherwise("cc")
        return F.when(w != "", found(unit, F.lit(1), w))

    return let(F.regexp_extract(s, MEASURE, 0), measure)


def ing_connectors(c: Column) -> Column:
    """Leading de, du, des and d' taken off, each once and in this order."""
    return js_trim(F.regexp_replace(c, rx("(?i)^(?:de{s}+)?(?:du{s}+)?(?:des{s}+)?(?:d['’]{s}*)?"), ""))


def ing_container(c: Column) -> Column:
    return F.regexp_replace(c, rx("(?i)^(?:gousses?|tranches?|branches?|sachets?|boi(?:te|tes)s?){s}+(?:de|d'|d’|du|des){s}+"), "")


def ing_paren(c: Column) -> Column:
    bare = F.regexp_replace(c, rx(r"(?i)\({s}*[\d.,]+{s}*(?:g|gr|kg|ml|cl|l){s}*\)"), " ")
    return js_trim(F.when(c.contains("("), bare).otherwise(c))


def ing_clean(c: Column) -> Column:
    """The line without hard spaces and blanks at its ends; null if nothing is left."""
    return F.nullif(js_trim(F.replace(c, F.lit(" "), F.lit(" "))), F.lit(""))


def parse_ingredient(line: Column) -> Column:
    """struct(name, quantity, unit) of a line; null for a blank one."""

    def after(o, r, q, u) -> Column:
        seasoning = ascii_lower(r).isin("sel", "poivre")
        unit = F.when(q.isNotNull(), F.coalesce(u["unit"], F.lit("unit"))).when(seasoning, "pincee").otherwise("unit")
        amount = F.when(q.isNotNull(), q["q"] * F.coalesce(u["factor"], F.lit(1))).otherwise(F.lit(1.0))
        text = F.when(q.isNotNull(), _rest(r, q["n"])).otherwise(r)
        text = F.when(u.isNotNull(), _rest(text, u["n"])).otherwise(text)
        name = capitalize_first(js_trim(let(ing_paren(ing_container(ing_connectors(text))), lambda n: F.coalesce(F.nullif(n, F.lit("")), o))))
        good = (amount > 0) & (amount < float("inf")) & ~F.isnan(amount)
        return F.struct(name.alias("name"), F.when(good, amount).otherwise(F.lit(1.0)).alias("quantity"), unit.alias("unit"))

    def whole(o: Column) -> Column:
        rest = ing_fractions(js_trim(F.regexp_replace(o, rx("^[-*•]{s}+"), "")))
        return let(rest, lambda r: let(ing_quantity(js_trim(r)), lambda q: let(F.when(q.isNotNull(), ing_unit(_rest(r, q["n"]))), lambda u: after(o, r, q, u))))

    return let(ing_clean(line), lambda o: F.when(o.isNotNull(), whole(o)))


def _rest(s: Column, n: Column) -> Column:
    return js_trim(F.substring(s, n + 1, F.length(s)))
