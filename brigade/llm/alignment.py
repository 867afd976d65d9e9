"""Operator 13: two tokenizers' tokens aligned by a sweep over the offsets at which they end."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, pieces
from .shared import byte_batches, documents, stash

#: Events are kept in runs: ``ids`` (compressed) are tokens of one side one after another, the first of
#: which begins at ``at``; where each ends follows from its bytes.
EVENTS = "row long, doc_id long, at long, side int, ids binary"
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, last boolean, whole boolean, pairs array<long>, times array<long>"
#: A run's tokens end in one stretch of so many bytes of the text.
_STRETCH = 1 << 15
#: Ids are below 1 << this.
_IDS = 21
_CODEC = pa.Codec("zstd", compression_level=1)


class Tokenizers:
    """Ids of both sides with special strings as plain text, and the bytes of each id.

    Both sides have a boundary before a single space, and before a single newline, between two
    characters that aren't white space. What stands between such places is encoded once and kept in
    a cache that is bounded by its entries and their characters.
    """

    def __init__(self, a: str, b: str, cache: int = 700_000):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = bpe._byte_letters()
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token if c in letters)
        self.fast = bpe.encoder(a).fast
        self.own = Tokenizer.from_file(a)
        self.own.encode_special_tokens = True
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=b)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(pieces.MARK, " ").encode() for i, p in enumerate(names)]
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        self.kind = np.dtype("<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4")
        marks = not any(pieces.MARK in p.lstrip(pieces.MARK) for p in names)
        lines = not any("\n" in p for p in names)
        apart = " " * marks + "\n" * lines
        # white space that isn't one character of `apart` binds what stands around it together
        self.units = re.compile(rf"\s+\S+(?:(?:\s{{2,}}|[^\S{apart}])\S+)*(?:\s+\Z)?|\s+|\S+" if apart else r"(?s).+")
        self.most = cache
        self._clear()

    def _new(self, units: list[str]) -> None:
        """Take units up into the cache: those that have boundaries on both ends wherever they stand are
        encoded as one text, the others one by one."""
        plain, other = [], []
        for u in units:
            (plain if u[0] in " \n" and len(u) < 4096 and not u[1:2].isspace() and not u[-1].isspace() else other).append(u)
        if plain:
            self._joined(plain)
        for u in other:
            # the fast engine's time grows with the square of a run
            a = self.own.encode(u, add_special_tokens=False).ids if bpe._RUN.search(u) else self.fast.encode_ordinary(u)
            b = self.sp.encode(u[1:]) if u[0] == " " else self.sp.encode(u)[1:]
            if self._same((a, b), u):
                self._add([u], [[np.array(x, self.kind)] for x in (a, b)])
            else:
                self.cache[u] = -1

    def _same(self, found, text: str) -> bool:
        raw = text.encode()
        return all(b"".join(map(side.__getitem__, ids)) == raw for side, ids in zip((self.a_bytes, self.b_bytes), found))

    def _add(self, units: list[str], found) -> None:
        first = len(self.bounds[0]) - 1
        self.cache.update(zip(units, range(first, first + len(units))))
        self.held += sum(map(len, units))
        for side in (0, 1):
            sizes = np.array([len(x) for x in found[side]], np.int64)
            self.bounds[side] = np.concatenate([self.bounds[side], self.bounds[side][-1] + np.cumsum(sizes)])
            self.ids[side] = np.concatenate([self.ids[side], *found[side]])

    def _joined(self, units: list[str]) -> None:
        text = " ." + "".join(units)  # it begins with a space, as each text does
        found = self.fast.encode_ordinary(text), self.sp.encode(text[1:])
        if not self._same(found, text):
            if len(units) == 1:
                self.cache[units[0]] = -1
            else:  # one of them isn't given back: look for it
                self._joined(units[: len(units) // 2])
                self._joined(units[len(units) // 2 :])
            return
        bounds = 2 + np.cumsum([0, *(len(u.encode()) for u in units)])
        out = []
        for ids, lengths in zip(found, self.lengths):
            ids = np.array(ids, self.kind)
            at = np.searchsorted(np.cumsum(lengths[ids]), bounds, "right")
            out.append([ids[i:j] for i, j in zip(at, at[1:])])
        self._add(units, out)

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}  # a unit's number among those kept; -1: its bytes differ
        self.ids = [np.zeros(0, self.kind)] * 2
        self.bounds = [np.zeros(1, np.int64)] * 2
        self.held = 0

    def encode(self, sections: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for sections that each begin with white space at a boundary of both, None
        where the bytes of either differ."""
        split = [self.units.findall(s) for s in sections]
        new = set().union(*split).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > self.most or self.held > 32 << 20:
                self._clear()
                new = set().union(*split)
            self._new(list(new))
        bounds = np.cumsum([0, *map(len, split)])
        units = np.fromiter(map(self.cache.__getitem__, itertools.chain.from_iterable(split)), np.int64, bounds[-1])
        bad = np.concatenate([[0], np.cumsum(units < 0)])
        good = [i for i in range(len(split)) if bad[bounds[i]] == bad[bounds[i + 1]]]
        units = np.maximum(units, 0)
        sides = []
        for ids, at in zip(self.ids, self.bounds):
            if len(at) == 1:
                sides.append([])
                continue
            sizes = at[units + 1] - at[units]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            every = ids[np.repeat(at[units] - ends[:-1], sizes) + np.arange(ends[-1])]
            sides.append((every, ends[bounds]))
        out = [None] * len(split)
        for i in good:
            out[i] = tuple(every[cuts[i] : cuts[i + 1]] for every, cuts in sides)
        return out

    def runs(self, side: int, ids: np.ndarray, start: int):
        """(at, side, ids) of a section's tokens, whose bytes begin at ``start``, stretch by stretch."""
        lengths = self.lengths[side][ids]
        ends = start + np.cumsum(lengths)
        stretch = (ends - 1) // _STRETCH
        cuts = np.flatnonzero(np.diff(stretch)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(ids)]):
            if j > i:
                yield int(ends[i] - lengths[i]), side, ids[i:j]


@lru_cache(maxsize=1)
def tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def packed(ids: np.ndarray) -> bytes:
    """Ids as bytes: their size, then compressed."""
    raw = ids.tobytes()
    return struct.pack("<I", len(raw)) + _CODEC.compress(raw, asbytes=True)


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    (size,) = struct.unpack_from("<I", data)
    return np.frombuffer(_CODEC.decompress(data[4:], size, asbytes=True) if size else b"", kind).astype(np.int64)


def token_events(docs: DataFrame, *, text: str = "text", key: str = "doc_id", a: str | None = None, b: str | None = None, section: int = 1 << 20) -> DataFrame:
    """The end events of both tokenizers' tokens over a space and the text, a few runs for each row.

    Rows are told apart by ``row``. A long text is encoded in sections cut where both tokenizers have a
    boundary, once to compare its bytes and once for its events, so that only a section is held. A row
    without tokens has one empty run.
    """
    paths = a or bpe.default_path(), b or pieces.default_path()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def long(tok, text):
        """The runs of one long text, or none where its bytes differ."""
        if all(tok.encode([s])[0] is not None for s in bpe.safe_pieces(text, section)):
            start = 0
            for s in bpe.safe_pieces(text, section):
                found = tok.encode([s])[0]
                for side in (0, 1):
                    yield from tok.runs(side, found[side], start)
                start += len(s.encode())

    def batch(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.int32()), pa.array(map(packed, cols[4]), pa.binary())], names=[f.split()[0] for f in EVENTS.split(", ")])

    def run(batches):
        tok = tokenizers(*paths)
        none = np.zeros(0, tok.kind)
        for whole in batches:
            for b in byte_batches(whole, most=2 << 20):
                out, size = [], 0
                texts = b.column(2).to_pylist()
                short = [i for i, t in enumerate(texts) if t and len(t) < section]
                ready = dict(zip(short, tok.encode([" " + texts[i] for i in short])))
                for i, (row, doc, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts)):
                    if i in ready:
                        found = ready.pop(i)
                        got = [] if found is None else [r for side in (0, 1) for r in tok.runs(side, found[side], 0)]
                    else:
                        got = long(tok, " " + t) if t else []
                    empty = True
                    for at, side, ids in got:
                        empty = False
                        out.append((row, doc, at, side, ids))
                        size += len(ids)
                        if size > 1 << 20:
                            yield batch(out)
                            out, size = [], 0
                    if empty:
                        out.append((row, doc, 0, 0, none))
                if out:
                    yield batch(out)

    return rows.mapInArrow(run, EVENTS)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, from the left, and how many there are."""
    at = np.arange(n)
    count = np.maximum(1, np.floor(np.log10(np.maximum(at, 1) + 0.5)).astype(np.int64) + 1)
    width = int(count.max(initial=1))
    out = np.zeros((n, width), np.uint8)
    for j in range(width):
        has = count > j
        out[has, j] = 48 + at[has] // 10 ** (count[has] - 1 - j) % 10
    return out, count


class _Document:
    """What the sweep keeps of the document it is in: counts, a running hash, the tokens since the last
    common end, and distinct pairs, which go out when there are many."""

    def __init__(self, row: int, doc_id):
        self.row, self.doc_id = row, doc_id
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.hash = hashlib.sha256()
        self.open = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.pairs, self.times, self.whole = [], [], True

    def merged(self):
        if len(self.pairs) > 1:
            pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
            pairs, where = np.unique(pairs, return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, where, times)
            self.pairs, self.times = [pairs], [total]
        return (self.pairs[0], self.times[0]) if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def record(self, last: bool):
        pairs, times = self.merged()
        self.pairs, self.times = [], []
        return (self.row, self.doc_id, self.n_a, self.n_b, self.n_groups, self.n_links, (self.hash.hexdigest() if self.n_groups else "") if last else None, last, self.whole, pairs, times)


class Sweep:
    """Reads runs ordered by row, place and side, and closes a group wherever tokens of both sides end.
    Between two calls it holds the last document's open group, counts and hash, and at most about
    ``hold`` of its distinct pairs."""

    def __init__(self, lengths: list[np.ndarray], hold: int = 1 << 21, products: int = 1 << 21):
        self.doc: _Document | None = None
        self.lengths = lengths
        self.hold, self.products = hold, products
        self.digits, self.count = _digits(1 << 16)

    def feed(self, rows, doc_ids, ats, sides, ids):
        """Yield the records of documents that are over, or have too many pairs to hold."""
        change = np.flatnonzero(np.diff(rows)) + 1
        firsts = np.concatenate([[0], change])
        ordinal = np.zeros(len(rows), np.int64)
        ordinal[change] = 1
        ordinal = np.cumsum(ordinal)
        if self.doc is not None and self.doc.row != rows[0]:
            yield self.doc.record(True)
            self.doc = None
        docs = [self.doc or _Document(int(rows[0]), doc_ids[0])] + [_Document(int(rows[i]), doc_ids[i]) for i in firsts[1:]]
        keys, tokens, new = [], [], []
        for side in (0, 1):
            mine = np.flatnonzero(sides == side)
            t = [ids[i] for i in mine if len(ids[i])]
            mine = np.array([i for i in mine if len(ids[i])], np.int64)
            sizes = np.array([len(x) for x in t], np.int64)
            t = np.concatenate(t) if t else np.zeros(0, np.int64)
            owner = np.repeat(ordinal[mine], sizes)
            total = np.cumsum(self.lengths[side][t])
            before = np.concatenate([[0], total[np.cumsum(sizes)[:-1] - 1]]) if len(mine) else np.zeros(0, np.int64)
            key = total + np.repeat((ordinal[mine] << 42) + ats[mine] - before, sizes)
            new.append(np.bincount(owner, minlength=len(docs)))
            keys.append(np.concatenate([docs[0].open[side][0], key]))  # the open group is of document 0
            tokens.append(np.concatenate([docs[0].open[side][1], t]))
        at = np.searchsorted(keys[1], keys[0])  # both rise
        common = keys[0][np.append(keys[1], -1)[at] == keys[0]]
        of = common >> 42
        group = []
        for side in (0, 1):
            g = np.searchsorted(common, keys[side])
            owner = keys[side] >> 42
            closed = g < len(common)
            closed[closed] = of[g[closed]] == owner[closed]
            left = np.flatnonzero(~closed)  # stays open if it's the last document's, else belongs to no group
            left = left[owner[left] == len(docs) - 1]
            group.append((g[closed], tokens[side][closed], keys[side][left] - ((len(docs) - 1) << 42), tokens[side][left]))
        (g_a, t_a, *open_a), (g_b, t_b, *open_b) = group
        p, q = np.bincount(g_a, minlength=len(common)), np.bincount(g_b, minlength=len(common))
        bounds = np.searchsorted(of, np.arange(len(docs) + 1))  # groups of each document
        text, cuts = self._text(docs[0].n_groups, g_a, t_a, g_b, t_b, p, q, bounds)
        links = np.concatenate([[0], np.cumsum(p * q)])
        for i, d in enumerate(docs):
            d.n_a += int(new[0][i])
            d.n_b += int(new[1][i])
            d.n_groups += int(bounds[i + 1] - bounds[i])
            d.n_links += int(links[bounds[i + 1]] - links[bounds[i]])
            d.hash.update(text[cuts[i] : cuts[i + 1]])
        docs[0].open = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        docs[-1].open = [tuple(open_a), tuple(open_b)]
        for key, times in self._pairs(of, t_a, t_b, p, q, links):
            owners = key >> (2 * _IDS)
            pair = key & ((1 << (2 * _IDS)) - 1)
            for i in range(int(owners[0]), int(owners[-1]) + 1) if len(key) else ():
                x, y = np.searchsorted(owners, [i, i + 1])
                if y > x:
                    d = docs[i]
                    d.pairs.append(pair[x:y])
                    d.times.append(times[x:y])
                    if sum(map(len, d.pairs)) > self.hold and len(d.merged()[0]) > self.hold // 2:
                        d.whole = False
                        yield d.record(False)
        for d in docs[:-1]:
            yield d.record(True)
        self.doc = docs[-1]

    def _text(self, before: int, g_a, t_a, g_b, t_b, p, q, bounds) -> tuple[bytes, list[int]]:
        """The groups' ids as text, and where each document's begin."""
        n_a, n_b = np.concatenate([[0], np.cumsum(p)]), np.concatenate([[0], np.cumsum(q)])
        total = len(t_a) + len(t_b)
        ids, mark = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[np.arange(len(t_a)) + n_b[g_a]] = t_a
        ids[np.arange(len(t_b)) + n_a[g_b + 1]] = t_b
        heads = n_a[:-1] + n_b[:-1]
        mark[heads] = ord(";")
        mark[n_a[1:] + n_b[:-1]] = ord("|")
        begins = np.unique(bounds[:-1])
        begins = begins[begins < len(p)]
        bare = np.zeros(total, bool)
        bare[heads[begins if not before or bounds[1] == 0 else begins[begins > 0]]] = True
        top = int(ids.max(initial=0)) + 1
        if top > len(self.digits):
            self.digits, self.count = _digits(1 << top.bit_length())
        size = self.count[ids]
        wide = size + ~bare
        ends = np.concatenate([[0], np.cumsum(wide)])
        out = np.zeros(int(ends[-1]), np.uint8)
        out[ends[:-1][~bare]] = mark[~bare]
        at = ends[1:] - size
        for j in range(self.digits.shape[1]):
            has = size > j
            if has.any():
                out[at[has] + j] = self.digits[ids[has], j]
        heads = np.concatenate([heads, [total]])
        return out.tobytes(), ends[heads[bounds]].tolist()

    def _pairs(self, of, t_a, t_b, p, q, links):
        """(document << 42 | a << 21 | b, how often) of linked tokens, about ``products`` links at a time."""
        a0, b0 = np.concatenate([[0], np.cumsum(p)]), np.concatenate([[0], np.cumsum(q)])
        at, n = 0, len(p)
        while at < n:
            to = max(at + 1, int(np.searchsorted(links, links[at] + self.products, "right")) - 1)
            if to == at + 1 and links[to] - links[at] > self.products:  # one wide group: its distinct ids, rows of them at a time
                x, x_times = np.unique(t_a[a0[at] : a0[to]], return_counts=True)
                y, y_times = np.unique(t_b[b0[at] : b0[to]], return_counts=True)
                step = max(1, self.products // len(y))
                for i in range(0, len(x), step):
                    key = (of[at] << (2 * _IDS)) | (x[i : i + step, None] << _IDS) | y
                    yield key.ravel(), (x_times[i : i + step, None] * y_times).ravel()
            else:
                size = p[at:to] * q[at:to]
                g = np.repeat(np.arange(at, to), size)
                within = np.arange(len(g)) - (links[g] - links[at])
                a = t_a[a0[g] + within // q[g]]
                b = t_b[b0[g] + within % q[g]]
                yield np.unique((of[g] << (2 * _IDS)) | (a << _IDS) | b, return_counts=True)
            at = to

    def close(self):
        if self.doc is not None:
            yield self.doc.record(True)
            self.doc = None


def sweep(events: DataFrame, *, a: str | None = None, b: str | None = None, hold: int = 1 << 21) -> DataFrame:
    """Groups and links of documents from the end events of two tokenizers, by documents and offset.

    Rows of ALIGNED: the last one of each document has its counts and the hash of its groups. ``pairs``
    (a's id << 21 | b's) and ``times`` are its linked ids; a document of very many pairs has several
    rows, which aren't ``whole``. What follows the last common end is in no group.
    """
    order = events.repartition("row").sortWithinPartitions("row", "at", "side")
    paths = a or bpe.default_path(), b or pieces.default_path()

    def batch(records):
        cols = list(zip(*records))
        arrays = [pa.array(c, k) for c, k in zip(cols[:9], [pa.int64()] * 6 + [pa.string(), pa.bool_(), pa.bool_()])]
        for c in cols[9:]:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in c])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(c).astype(np.int64))))
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in ALIGNED.split(", ")])

    def run(batches):
        tok = tokenizers(*paths)
        machine = Sweep(tok.lengths, hold)
        for b in batches:
            for part in byte_batches(b, "ids", most=1 << 20):
                rows, ats, sides = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                held, size = [], 0
                for r in machine.feed(rows, part.column(1).to_pylist(), ats, sides, [unpacked(x, tok.kind) for x in part.column(4).to_pylist()]):
                    held.append(r)
                    size += len(r[9])
                    if size > 1 << 20:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)
        if tail := list(machine.close()):
            yield batch(tail)

    return order.mapInArrow(run, ALIGNED)


def linked(aligned: DataFrame) -> DataFrame:
    """(row, pair, times): each document's distinct linked id pairs."""
    each = lambda rows: rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    parts = each(aligned.where("not whole")).groupBy("row", "pair").agg(F.sum("times").alias("times"))
    return each(aligned.where("whole")).unionByName(parts)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, held, best): in how many documents a pair is linked, and the most of any pair of its first id."""
    held = links.groupBy("pair").agg(F.count("*").alias("held")).withColumn("a", F.shiftright("pair", _IDS))
    best = held.groupBy("a").agg(F.max("held").alias("best"))
    return held.join(best, "a").select("pair", "held", "best")


def align(docs: DataFrame, *, text: str = "text", key: str = "doc_id", a: str | None = None, b: str | None = None, section: int = 1 << 20, hold: int = 1 << 21) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each input row.

    ``a`` names a byte-level BPE file, ``b`` a sentence-piece model; both encode a space and the text,
    special strings as plain text. Null and empty texts, and those whose bytes either side doesn't
    give back (such as those with the mark U+2581), have no tokens: zeros and ''. Repeated rows and
    repeated or null keys are documents of their own. Very long texts stream through in sections. A pair
    that most documents hold is split by the adaptive join. Extra columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    aligned = stash(sweep(token_events(docs, text=text, key=key, a=a, b=b, section=section), a=a, b=b, hold=hold), "aligned", codec="zstd", tidy=True)
    links = linked(aligned)
    counts = stash(pair_counts(links), "pair-counts", tidy=True)
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("held")).alias("count_sum"), F.sum(F.when(F.col("held") == F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    done = aligned.where("last").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return done.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
