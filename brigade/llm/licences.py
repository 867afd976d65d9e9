"""Operator 12: licence notices and identifier tags in whole texts, and what the tags' expressions ask for."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_batches, documents, tagged

# The phrases whose places are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices, in words, and the labels they add.
NOTICES = {
    "academic free license": "afl",
    "apache software license": "apache",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "common development and distribution license": "cddl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "open data commons open database license": "odbl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "sil open font license": "ofl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "zlib license": "zlib",
}
# What licences of a family ask for, from 1 (nothing) to 6 (no commercial use or no changes).
OBLIGATIONS = {
    "cc0": 1, "unlicense": 1, "wtfpl": 1, "0bsd": 1,
    "afl": 2, "apache": 2, "artistic": 2, "blueoak": 2, "bsd": 2, "bsl": 2, "cc-by": 2, "isc": 2, "mit": 2, "ms-pl": 2, "ofl": 2, "postgresql": 2, "psf": 2, "python": 2, "zlib": 2,
    "cddl": 3, "epl": 3, "eupl": 3, "lgpl": 3, "mpl": 3, "ms-rl": 3,
    "cc-by-sa": 4, "gfdl": 4, "gpl": 4, "odbl": 4,
    "agpl": 5, "osl": 5, "sspl": 5,
    "cc-by-nc": 6, "cc-by-nd": 6,
}
#: The obligation of an identifier that no family has.
UNKNOWN = 7
_FAMILIES = sorted(OBLIGATIONS)
_BIT = {f: 1 << i for i, f in enumerate(_FAMILIES)}
#: family, version, what it is followed by: gpl-2.0-or-later, bsd-3-clause, cc-by-nc-sa-4.0, mit
_IDENTIFIER = re.compile(f"({'|'.join(sorted(map(re.escape, OBLIGATIONS), key=len, reverse=True))})((?:-(?:[0-9v.]+|clause|only|or|later|sa|nd|nc|attribution|patent|clear|new))*\\+?)")

#: Bytes of words stay, with A-Z lower-cased; all others become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What stands between a tag's name and its value.
_VALUE = re.compile(r"[\"']?[ \t]{0,8}[:=][ \t]{0,8}([\"']?)")
_TOKEN = re.compile(r"[ \t]*(?:([()])|([a-z0-9][a-z0-9.:+-]*))")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

PLACES = "array<struct<label:string,base:boolean,word:long>>"
TAGS = "array<struct<expression:string,valid:boolean,known:boolean,labels:array<string>,chosen:array<string>,obligation:int>>"
SCHEMA = f"doc_id long, n_words long, places {PLACES}, tags {TAGS}, labels array<string>, score double"


def family(identifier: str) -> str | None:
    """The family of a licence identifier in lower case, or None."""
    m = _IDENTIFIER.fullmatch(identifier)
    if not m:
        return None
    if m[1] == "cc-by":  # the strictest of its further letters counts
        return next((f"cc-by-{x}" for x in ("nc", "nd", "sa") if f"-{x}" in m[2]), "cc-by")
    return m[1]


def evaluate(text: str, at: int = 0) -> dict:
    """The licence expression in lower case that begins at ``at`` and ends where no operator follows, by
    two stacks (shunting-yard): ``with`` binds closer than ``and``, and that closer than ``or``.

    Of alternatives the one that asks for least is chosen, the first one of equals; joined licences ask
    for what the strictest asks; an exception lowers copyleft by one. Not valid: no licence, an operator
    or a parenthesis without its partner. ``known``: every licence is of a known family.
    """
    values, ops, every, known, valid, operand, end = [], [], 0, True, True, True, at

    def reduce() -> bool:
        op = ops.pop()
        if op == "(" or len(values) < 2:
            return False
        (r2, m2), (r1, m1) = values.pop(), values.pop()
        if op == "with":
            values.append((r1 - 1 if 3 <= r1 <= 5 else r1, m1))
        elif op == "and":
            values.append((max(r1, r2), m1 | m2))
        else:
            values.append((r1, m1) if r1 <= r2 else (r2, m2))
        return True

    while valid and (m := _TOKEN.match(text, end)):
        mark, name = m[1], m[2]
        if name:
            name = name.rstrip(".:-")
        if operand:  # a licence or an opening parenthesis is due
            if mark == "(":
                ops.append(mark)
            elif name and name not in _PRECEDENCE:
                exception = bool(ops) and ops[-1] == "with"
                found = None if exception else family(name)
                known = known and (exception or found is not None)
                every |= _BIT.get(found, 0)
                values.append((0 if exception else OBLIGATIONS.get(found, UNKNOWN), _BIT.get(found, 0)))
                operand = False
            else:
                valid = False
                break
        elif mark == ")":
            while ops and ops[-1] != "(":
                valid = reduce() and valid
            if not ops:  # it closes what was opened before the expression
                break
            ops.pop()
        elif name in _PRECEDENCE:
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[name]:
                valid = reduce() and valid
            ops.append(name)
            operand = True
        else:
            break
        end = m.end() if not name else m.start(2) + len(name)
    valid = valid and not operand
    while valid and ops:
        valid = reduce()
    valid = valid and len(values) == 1
    names = lambda mask: [f for f in _FAMILIES if _BIT[f] & mask]
    return {"expression": text[at:end].strip(), "valid": valid, "known": valid and known, "labels": names(every) if valid else [], "chosen": names(values[0][1]) if valid else [], "obligation": values[0][0] if valid else None}


class Scanner:
    """Two automata: one finds the phrases' words, one the names of tags."""

    def __init__(self, base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]):
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for kind, table in ((True, base), (False, notices)):
            for phrase, label in table:
                words = phrase.encode().translate(_WORDS).split()
                if words:
                    found.setdefault(b" ".join(words).decode("latin-1"), []).append((label, kind, len(words)))
        for phrase, labels in found.items():
            self.phrases.add_word(f" {phrase} ", (len(phrase), labels))
        self.longest = max((p.count(" ") + 1 for p in found), default=1)
        self.tags = ahocorasick.Automaton()
        for name in ("license", "licence", "spdx-license-identifier"):
            self.tags.add_word(name, name)
        for machine in (self.phrases, self.tags):
            if len(machine):
                machine.make_automaton()

    def places(self, data: bytes, chunk: int = 1 << 20) -> tuple[int, list]:
        """(words, places of phrases as (label, base, word)) of a text's bytes. Words are taken ``chunk``
        bytes at a time, each chunk beginning with the last words of the one before."""
        data = data.translate(_WORDS)
        at, count, held, out = 0, 0, [], []
        while at < len(data):
            cut = len(data) if len(data) - at <= chunk else data.find(b" ", at + chunk)
            cut = len(data) if cut < 0 else cut
            words = held + data[at:cut].split()
            first, at = count - len(held), cut
            if len(self.phrases):
                text = f" {b' '.join(words).decode('latin-1')} "
                seen, upto = 0, 0
                for end, (n, labels) in self.phrases.iter(text):
                    seen += text.count(" ", upto, end)  # words that end before the phrase does, and it
                    upto = end
                    for label, kind, size in labels:
                        if seen > len(held):  # else its last word was in the chunk before
                            out.append((label, kind, first + seen - size))
            count = first + len(words)
            held = words[-(self.longest - 1) :] if self.longest > 1 else []
        return count, out

    def expressions(self, data: bytes) -> list[dict]:
        """The expressions that follow tags: those of identifier tags all, others where every licence is known."""
        text, out, after = data.translate(_LOWER).decode(errors="replace"), [], 0
        for end, name in self.tags.iter(text):
            begin = end + 1 - len(name)
            if begin < after or (name != "spdx-license-identifier" and begin and (text[begin - 1].isalnum() or text[begin - 1] in "-_")):
                continue
            value = _VALUE.match(text, end + 1)
            if not value:
                continue
            found = evaluate(text, value.end())
            if name == "spdx-license-identifier" or found["known"]:
                out.append(found)
                after = value.end()
        return out


@lru_cache(maxsize=2)
def scanner(base, notices) -> Scanner:
    return Scanner(base, notices)


def _score(places: list, tags: list[dict]) -> float:
    """How sure a licence is named: each label counts by its best evidence, a tag (0.95), a further
    notice (0.8) or a base phrase (0.6); labels count as independent."""
    best: dict[str, float] = {}
    for label, kind, _ in places:
        best[label] = max(best.get(label, 0.0), 0.6 if kind else 0.8)
    for t in tags:
        for label in t["labels"]:
            best[label] = 0.95
    miss = 1.0
    for label in sorted(best):
        miss *= 1.0 - best[label]
    return 1.0 - miss


def license_scan(docs: DataFrame, *, text: str = "text", key: str = "doc_id", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Rows (doc_id, n_words, places, tags, labels, score), one for each input row, without a shuffle.

    Words are runs of letters a-z (A-Z lower-cased), digits and bytes from 0x80. ``places`` are the words
    at which the phrases of ``base`` and ``notices`` begin, ``tags`` the licence expressions that follow
    ``SPDX-License-Identifier:`` or ``license:``, evaluated; ``labels`` are the distinct labels of both,
    sorted. Whole texts are read, long ones a chunk at a time. Null and empty texts, and those without
    words, have neither. Repeated rows and repeated or null keys: a row each. Extra columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    tables = tuple(base.items()), tuple(notices.items())

    def run(batches):
        scan = scanner(*tables)
        for whole in batches:
            for b in byte_batches(whole):
                n, places, tags, labels, scores = [], [], [], [], []
                for t in b.column(1).cast(pa.binary()).to_pylist():
                    count, found = scan.places(t)
                    asked = scan.expressions(t)
                    n.append(count)
                    places.append([{"label": x, "base": k, "word": w} for x, k, w in found])
                    tags.append(asked)
                    labels.append(sorted({x for x, _, _ in found}.union(*(a["labels"] for a in asked))))
                    scores.append(_score(found, asked))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(places, _PLACES), pa.array(tags, _TAGS), pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())], names=["doc_id", "n_words", "places", "tags", "labels", "score"])

    return tagged(docs, text, key).mapInArrow(run, SCHEMA)


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64())]))
_TAGS = pa.list_(pa.struct([("expression", pa.string()), ("valid", pa.bool_()), ("known", pa.bool_()), ("labels", pa.list_(pa.string())), ("chosen", pa.list_(pa.string())), ("obligation", pa.int32())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the base phrases as counts and bounds, all labels, and what the tags ask for."""
    found = license_scan(documents(spark, sf_dir))
    at = F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["word"])
    named = F.array_sort(F.array_distinct(F.transform(F.filter("places", lambda p: p["base"]), lambda p: p["label"])))
    return found.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(named, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
        F.size("tags").cast("long").alias("n_tags"), F.array_max(F.transform("tags", lambda t: t["obligation"])).alias("obligation"),
    )
