"""What ingredients and texts say about a recipe, and its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jscompat import js_trim, let
from ..functions.rules import AISLE_RULES, ALLERGEN_RULES, BATCH_PHRASES, NOT_VEGETARIAN, SEASONAL
from ..functions.text import ascii_lower, fold, keyword_regex, tokenize, tokens_text


def aisle(name: Column) -> Column:
    """The first rule's aisle that a name matches; null if none does."""
    return let(tokens_text(name), _aisle)


def _aisle(tokens: Column) -> Column:
    return F.coalesce(*[F.when(tokens.rlike(keyword_regex(k)), F.lit(a)) for a, k in AISLE_RULES])


def folded(names: Column) -> Column:
    """All names of a recipe folded at once: a line of tokens for each."""
    lines = F.array_join(F.transform(names, lambda n: F.translate(n, "\n", " ")), "\n")
    return F.regexp_replace(ascii_lower(lines), "[^a-z0-9\n]+", " ")


def _any(lines: Column, keywords: list[str]) -> Column:
    """Whether a line of folded names has one of the keywords."""
    return lines.rlike("(?m)" + keyword_regex(keywords))


def aisles(ingredients: Column, lines: Column) -> Column:
    """Ingredients with their aisles, from the folded names' lines."""
    each = F.zip_with(ingredients, F.split(lines, "\n"), lambda i, t: i.withField("aisle", _aisle(t)))
    return F.when(F.size(ingredients) > 0, each).otherwise(F.transform(ingredients, lambda i: i.withField("aisle", F.lit(None).cast("string"))))


def allergens(names: Column) -> Column:
    return allergens_in(folded(names))


def allergens_in(lines: Column) -> Column:
    return let(lines, lambda t: F.filter(F.array(*[F.when(_any(t, k), F.lit(a)) for a, k in ALLERGEN_RULES]), lambda x: x.isNotNull()))


def seasonal(names: Column) -> Column:
    return seasonal_in(folded(names))


def seasonal_in(lines: Column) -> Column:
    return _any(lines, SEASONAL)


def vegetarian(diets: Column, names: Column) -> Column:
    """A vegetarian or vegan diet says so; else no ingredient may be of meat or fish."""
    return vegetarian_in(diets, folded(names))


def vegetarian_in(diets: Column, lines: Column) -> Column:
    said = F.exists(F.coalesce(diets, F.array().cast("array<string>")), lambda d: ascii_lower(d).contains("vegetariandiet") | ascii_lower(d).contains("vegandiet"))
    return said | ~_any(lines, NOT_VEGETARIAN)


def batch_friendly(name: Column, description: Column, steps: Column) -> Column:
    """Whether a phrase about keeping or preparing ahead is part of the texts."""
    text = ascii_lower(F.concat_ws(" \n ", name, description, steps))
    return text.rlike("|".join(fold(p) for p in BATCH_PHRASES))


ISO = r"(?i)^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def iso_duration(c: Column) -> Column:
    """Minutes of an ISO 8601 duration of days, hours, minutes and seconds; null if zero or of another form."""
    s = js_trim(c)
    d, h, m, sec = (F.coalesce(F.regexp_extract(s, ISO, i).try_cast("double"), F.lit(0.0)) for i in (1, 2, 3, 4))
    total = d * 1440 + h * 60 + m + F.ceil(sec / 60).cast("double")
    return F.when(s.rlike(ISO) & (total > 0), total)


def total_minutes(total: Column, prep: Column, cook: Column) -> Column:
    t, p, c = iso_duration(total), iso_duration(prep), iso_duration(cook)
    return F.coalesce(t, p + c, p, c, F.lit(30.0))


def servings(text: Column) -> Column:
    """The first whole number of a yield text, 4 if none or not positive."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)", 1).try_cast("double")
    return F.when((n > 0) & (n < float("inf")), n).otherwise(F.lit(4.0))


def clamp_int(c: Column, low: int, high: int) -> Column:
    """Truncated and held within bounds; what isn't finite becomes the lower one."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))))).otherwise(F.lit(low)).cast("int")


DURATION = r"(?i)^(\d+(?:\.\d+)?)(ms|s|m|h|d)$"


def duration_ms(c: Column) -> Column:
    """Milliseconds of 1500, 250ms, 2s, 1.5s, 2m, 1h or 1d; null for another form."""
    s = js_trim(c)
    factor = F.element_at(F.create_map(*[F.lit(x) for x in ("ms", 1, "s", 1000, "m", 60_000, "h", 3_600_000, "d", 86_400_000)]), F.lower(F.regexp_extract(s, DURATION, 2)))
    plain = F.when(s.rlike(r"^\d+$"), s.try_cast("bigint"))
    return F.coalesce(plain, F.when(s.rlike(DURATION), F.floor(F.regexp_extract(s, DURATION, 1).try_cast("double") * factor + 0.5).cast("bigint")))


def rule_words(rules: DataFrame, keys: list[str], phrase: str = "phrase") -> DataFrame:
    """(keys, n, at, forms, word): rules' phrases folded to ``n`` words, each given by the array of forms that
    count as it, and the longest of them, at ``at``, in one row for each of its forms. Phrases without a
    word are left out."""
    words = tokenize(F.col(phrase))
    size = F.size("words")

    def forms(w, i):
        ends = F.substring(w, -1, 1).isin("s", "x")
        plain = F.array(w, F.concat(w, F.lit("s")), F.concat(w, F.lit("x")), F.when(ends, F.substring(w, F.lit(1), F.length(w) - 1)))
        more = F.when((size > 1) & (i == size - 1), F.transform(F.array(*map(F.lit, ("ss", "sx", "xs", "xx"))), lambda e: F.concat(w, e))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.filter(F.concat(plain, more), lambda x: x.isNotNull() & (x != "")))

    r = rules.select(*keys, words.alias("words")).where(size > 0)
    longest = F.array_max(F.transform("words", lambda w: F.length(w)))
    r = r.select(*keys, size.alias("n"), F.array_position(F.transform("words", lambda w: F.length(w)), longest).cast("int").alias("at"), F.transform("words", forms).alias("forms"))
    return r.withColumn("at", F.col("at") - 1).withColumn("word", F.explode(F.get("forms", F.col("at"))))


def match_rules(texts: DataFrame, rules: DataFrame, *, key: list[str], text: str, rule: list[str], phrase: str = "phrase", words: int = 8) -> DataFrame:
    """(key, rule, pos): the places, in words from 0, at which a rule's phrase stands in a text, its words in the
    forms that ``keyword_regex`` takes: rules from a table of any size, in place of patterns.

    Each word of a text is joined with the rules' longest words, and carries its neighbours, so that the
    rest of a phrase is compared beside it. Rules of more than ``words`` words are an error. A text
    of null has no words; equal rows of texts or rules count each.
    """
    r = rule_words(rules, rule, phrase)
    r = r.withColumn("n", F.when(F.col("n") > words, F.raise_error(F.concat(F.lit("more words than expected in a rule: "), F.col("n").cast("string"))).cast("int")).otherwise(F.col("n")))
    t = texts.select(*key, tokenize(F.col(text)).alias("_all"))
    # pad so that every word has as many neighbours on both sides
    pad = F.array_repeat(F.lit(""), words - 1)
    t = t.select(*key, F.concat(pad, F.col("_all"), pad).alias("_all"), F.posexplode("_all").alias("_pos", "_word"))
    t = t.select(*key, "_pos", "_word", F.slice("_all", F.col("_pos") + 1, 2 * words - 1).alias("_near"))
    j = t.join(r, F.col("_word") == F.col("word"))
    first = F.lit(words - 1) - F.col("at")  # where the phrase would begin among the neighbours
    fits = F.forall(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array_contains(F.get("forms", i), F.get("_near", first + i)))
    return j.where(fits).select(*key, *rule, (F.col("_pos") - F.col("at")).alias("pos"))
