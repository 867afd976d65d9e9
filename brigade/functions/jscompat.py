"""White space, trimming and bounds as JavaScript's regular expressions see them, for Java's and Python's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What \s and trim() cover in JavaScript; Java's \s and Python's differ from it.
WS = "\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WS_CHARS = "\t\n\x0b\f\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
#: The same as a class that plain characters leave at once.
SPACE = f"[[^!-~]&&[{WS}]]"
#: The end of a word of ASCII letters, digits and underscores.
END = "(?![0-9A-Za-z_])"
START = "(?<![0-9A-Za-z_])"


def rx(pattern: str) -> str:
    r"""A Java pattern from one that writes {s} for a space class, {e} and {b} for a word's end and start."""
    return pattern.replace("{s}", SPACE).replace("{e}", END).replace("{b}", START)


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return js_trim(F.regexp_replace(c, rx("{s}+"), " "))


def let(c: Column, body) -> Column:
    """``body(c)`` with ``c`` computed once."""
    return F.element_at(F.transform(F.array(c), body), 1)


def struct_type(text: str) -> T.StructType:
    """A struct of strings, booleans, numbers and arrays of strings from 'name type, ...', without a session."""
    kinds = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(*(n, kinds[k])) for n, k in (f.split(" ") for f in text.split(", "))])


def number(c: Column) -> Column:
    return c.try_cast("double")
