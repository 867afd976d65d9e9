"""Operator 2: SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import byte_batches, documents, tagged

SCHEMA = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, round_trip boolean"
MARK = "▁"
#: Characters that no piece covers are numbered from here, above all pieces.
LOST = 1 << 21


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's pieces, and the segmentation of a text that the model gives, by a streaming Viterbi search.

    Every boundary of a text keeps a backpointer to where its last piece begins, and all pieces that
    end there are tried at once. Models of merges (type BPE, whose scores are ranks) are exact too:
    a text's segmentation continues that of each of its own boundaries, and two pieces may stand side
    by side where merging their characters alone gives just these two, so of the pieces that end at a
    boundary the one that may follow is the path to it. In other models (unigram) the path of the
    highest sum of scores counts, ties to the longer last piece.

    Text is taken as the model's identity normalisation does: a dummy space first, spaces as marks.
    A character that no piece covers becomes its UTF-8 bytes' pieces, or the unknown id.
    """

    def __init__(self, path: str, cache: int = 1_500_000, merges: bool | None = None):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        own = [i for i in range(len(self.names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(self.names)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.score = {self.names[i]: sp.get_score(i) for i in own}
        # ranks are whole numbers, log probabilities aren't
        self.merges = all(s == int(s) for s in self.score.values()) if merges is None else merges
        if not self.merges:  # scores that only fill a place (-1e9) would swamp the sums: they count as the worst real one less 1
            worst = min((s for s in self.score.values() if s > -1e8), default=0.0)
            self.score = {n: max(s, worst - 1) for n, s in self.score.items()}
            self.lost = worst - 10.0
        self.id = {self.names[i]: i for i in own}
        self.longest = max(map(len, self.score), default=1)
        self.machine = ahocorasick.Automaton()
        for name, i in self.id.items():
            self.machine.add_word(name, (len(name), i))
        self.machine.make_automaton()
        inner = {c for p in self.score if len(p) > 1 for c in p}
        # no piece has a mark after another character: all paths meet before such a mark
        self.marks = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.apart = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n") if self.marks and "\n" not in inner else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if self.marks else "(?s).+")
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.most = cache

    def together(self, x: str, y: str) -> bool:
        """Whether merging the characters of ``x`` and ``y`` gives these two symbols: neighbours of the highest
        score merge, the first ones of equal score, as often as any two can. ``x`` may be empty."""
        parts, edge = [*x, *y], len(x)  # so many symbols are before the edge between the two
        score, none = self.score.get, -math.inf
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            if i == edge - 1:
                return False
            if i < edge:
                edge -= 1
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
        return len(parts) == (2 if x else 1)

    def _name(self, i: int) -> str:
        return chr(i - LOST) if i >= LOST else self.names[i]

    def _follows(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow piece ``a`` (-1: begin a text); characters without a piece count from LOST."""
        key = (a + 1) * (2 * LOST) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 1 << 20:
                self.pairs.clear()
            x, y = self._name(a) if a >= 0 else "", self._name(b)
            found = self.pairs[key] = self.together(x, y)
        return found

    def viterbi(self, text: str, hold: int = 0):
        """Yield the ids of the segmentation, committing early.

        Only the last ``longest`` boundaries can still be reached back to. When ``hold`` boundaries
        wait, by default twice as many, the paths from all of those are followed back, and what they
        have in common is committed, so memory is bounded by how far paths stay apart, not by the text.
        """
        hold = due = hold or 2 * self.longest
        base, starts, ids, best = 0, [0], [-1], [0.0]  # of the boundaries from base on
        ranked, follows, pairs, stride = self.merges, self._follows, self.pairs, 2 * LOST
        for e, (n, piece) in self.machine.iter(text):
            while base + len(starts) <= e:  # boundaries that no piece has settled
                self._lost(text, base, starts, ids, best)
            k = e + 1 - n - base
            if len(starts) == e + 2 - base:  # settled: only a higher sum changes it
                if ranked or best[k] + self.score[self.names[piece]] <= best[-1]:
                    continue
                for held in (starts, ids, best):
                    held.pop()
            elif ranked:
                found = pairs.get((ids[k] + 1) * stride + piece)
                if not (follows(ids[k], piece) if found is None else found):
                    continue
            starts.append(e + 1 - n)
            ids.append(piece)
            if not ranked:
                best.append(best[k] + self.score[self.names[piece]])
            if len(starts) > due:
                meet = self._meet(starts, base)
                if meet > base:
                    yield from self._path(text, starts, ids, base, meet)
                    cut = meet - base
                    starts, ids, best, base = starts[cut:], ids[cut:], best[cut:], meet
                due = max(hold, len(starts) + self.longest)
        while base + len(starts) <= len(text):
            self._lost(text, base, starts, ids, best)
        yield from self._path(text, starts, ids, base, len(text))

    def _stream(self, parts: list[str]) -> list[array]:
        """Ids of parts, which hold no NUL, by one streaming search over all of them: no piece crosses the NUL
        between two, so their paths meet there, and its byte's id tells where each ends."""
        ids = array("I", self.viterbi("\0".join(parts)))
        ends = [*np.flatnonzero(np.frombuffer(ids, np.uint32) == self.bytes[0]).tolist(), len(ids)]
        return [ids[i:j] for i, j in zip([0, *(e + 1 for e in ends)], ends)]

    def _lost(self, text, base, starts, ids, best):
        """Settle the next boundary by a character without a piece."""
        at = base + len(starts) - 1
        starts.append(at)
        ids.append(LOST + ord(text[at]))
        if not self.merges:
            best.append(best[-1] + self.lost)

    def _meet(self, starts, base) -> int:
        """The last boundary that the paths from all boundaries still within reach have in common."""
        end = base + len(starts) - 1
        live = set(range(max(base, end - self.longest + 1), end + 1))
        while len(live) > 1:
            i = max(live)
            live.remove(i)
            live.add(max(base, starts[i - base]))
        return live.pop()

    def _path(self, text, starts, ids, base, end):
        out = []
        while end > base:
            i = ids[end - base]
            out += [i] if i < LOST else [self.bytes.get(b, self.unknown) for b in reversed(chr(i - LOST).encode())]
            end = starts[end - base]
        return reversed(out)

    def chunks(self, text: str) -> list[bytes]:
        """Ids, as bytes, of the parts of a text between which every path meets."""
        parts = self.split(text)
        cache = self.cache
        if len(cache) >= self.most:
            cache.clear()
            self.odd.clear()
        new = set(parts).difference(cache)
        if not new:
            return [cache[x] for x in parts]
        # sums of scores would lose digits over many parts
        joined = [x for x in new if "\0" not in x] if self.merges and 0 in self.bytes else []
        long = {}
        for part, ids in itertools.chain(zip(joined, self._stream(joined) if joined else ()), ((x, array("I", self.viterbi(x))) for x in new.difference(joined))):
            (cache if len(part) <= 48 else long)[part] = ids.tobytes()
            if self.plain(ids) != part:
                self.odd.add(part)
        return [cache[x] if x in cache else long[x] for x in parts] if long else [cache[x] for x in parts]

    def split(self, text: str) -> list[str]:
        return self.apart.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(self.chunks(text))).tolist()

    def round_trip(self, text: str, ids: bytes) -> bool:
        """Whether ``ids``, just encoded, decode to the text. Parts are decoded when they are first met."""
        if self.odd and not self.odd.isdisjoint(self.split(text)):
            return self.decode(array("I", ids)) == text
        return MARK not in text

    def plain(self, ids) -> str:
        """The normalised text of ids: pieces one after another, runs of byte pieces decoded together."""
        out = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is None:
                out += (self.names[i] if i != self.unknown else " ⁇ ").encode()
            else:
                out.append(b)
        return out.decode(errors="replace")

    def decode(self, ids) -> str:
        return self.plain(ids).replace(MARK, " ")[1:]


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    """One set of pieces for each Python worker; its cache of parts is bounded, at about 350 MB."""
    return Pieces(path)


def encode(docs: DataFrame, *, text: str = "text", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """Rows (doc_id, ids) with the ids of every whole text; nothing is shuffled.

    Null and empty texts have no ids. Repeated rows or keys give a row each; extra columns are
    ignored; an empty table gives an empty result.
    """
    path = model or default_path()

    def run(batches):
        p = pieces(path)
        for whole in batches:
            for b in byte_batches(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return tagged(docs, text, key).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, *, ids: str = "ids", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """Rows (doc_id, text) from arrays of ids. Null ids give a null text, no ids an empty one; marks
    that stood in a text come back as spaces."""
    path = model or default_path()

    def run(batches):
        p = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else p.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.selectExpr(f"cast(`{key}` as long) doc_id", f"`{ids}` ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, *, text: str = "text", key: str = "doc_id", model: str | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_pieces, ids_crc32, round_trip), one for each input row: every text is
    encoded, its ids are decoded again, and round_trip tells whether that gives the text (not where
    it holds the mark itself). Edge cases as for encode."""
    path = model or default_path()

    def run(batches):
        p = pieces(path)
        for whole in batches:
            for b in byte_batches(whole):
                rows = []
                for t in b.column(1).to_pylist():
                    ids = b"".join(p.chunks(t))
                    rows.append((len(t.encode()), len(ids) // 4, zlib.crc32(ids), p.round_trip(t, ids)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.bool_())], names=["doc_id", "n_bytes", "n_pieces", "ids_crc32", "round_trip"])

    return tagged(docs, text, key).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
