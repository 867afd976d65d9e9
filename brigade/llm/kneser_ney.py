"""Operator 4: scores of an interpolated modified Kneser-Ney bigram model counted in Spark."""

from __future__ import annotations

from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_batches, documents, filesystem, shared_folder, stash, tagged, write_file
from .words import word_hashes

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_16 = np.uint64(16)


def _tokens(col: pa.Array):
    """(hash of each token, how many tokens each row has): words, then one end in each row."""
    h, firsts = word_hashes(col)
    many = np.diff(firsts)
    w = np.full(len(h) + len(many), END)
    inside = np.ones(len(w), bool)
    inside[np.cumsum(many + 1) - 1] = False
    w[inside] = h
    return w, many + 1


def _bigrams(w: np.ndarray, many: np.ndarray):
    """(distinct tokens and BEGIN, the place among them of each token of ``w``, of the token before it):
    tokens are sorted once for both, as each follows another one or the beginning."""
    words, at = np.unique(np.append(w, BEGIN), return_inverse=True)
    at = at.astype(np.int32)
    before = np.roll(at, 1)[:-1]  # the last is the beginning's
    before[np.cumsum(many) - many] = at[-1]
    return words, at[:-1], before


def _codes(h: np.ndarray) -> np.ndarray:
    """The upper 48 bits of a word's hash: its code as a context."""
    return h >> _16


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _sum(keys: np.ndarray, counts: np.ndarray):
    """Ascending distinct keys and the sums of their counts (one row of ``counts`` for each column)."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[:, order]
    first = _heads(keys)
    return keys[first], np.add.reduceat(counts, first, axis=1) if len(first) else counts


def _planes(x: np.ndarray, used: int = 8) -> bytes:
    """Bytes of one place together, which compresses well in a shuffle; the upper ones may be left out."""
    return x.view(np.uint8).reshape(-1, x.itemsize)[:, :used].T.tobytes()


def _back(data: np.ndarray, n: int, kind: str, used: int = 8) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :used] = data.reshape(-1, n).T
    return out.view(kind).ravel()


def _pack(keys, counts) -> bytes:
    """Ascending keys as differences, and their counts."""
    return _planes(np.diff(keys, prepend=np.uint64(0))) + b"".join(_planes(c.astype("<u4")) for c in counts)


def _unpack(data, columns: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8)
    n = len(x) // (8 + 4 * columns)
    counts = [_back(x[(8 + 4 * c) * n : (12 + 4 * c) * n], n, "<u4") for c in range(columns)]
    return np.cumsum(_back(x[: 8 * n], n, "<u8"), dtype=np.uint64), np.array(counts, np.int64).reshape(columns, n)


def _pack_pairs(w, code, counts) -> bytes:
    """Bigrams by second word, then by the first's code: each second word once, with how many it has."""
    first = _heads(w)
    many = np.diff(np.append(first, len(w))).astype("<u4")
    return np.array([len(first)], "<u4").tobytes() + _planes(np.diff(w[first], prepend=np.uint64(0))) + _planes(many) + _planes(code, 6) + _planes(counts.astype("<u4"))


def _unpack_pairs(data) -> tuple:
    x = np.frombuffer(data, np.uint8)
    m = int(x[:4].view("<u4")[0])
    w, many = np.cumsum(_back(x[4 : 4 + 8 * m], m, "<u8"), dtype=np.uint64), _back(x[4 + 8 * m : 4 + 12 * m], m, "<u4")
    x, n = x[4 + 12 * m :], int(many.sum())
    return w, many, _back(x[: 6 * n], n, "<u8", 6), _back(x[6 * n :], n, "<u4").astype(np.int64)


def _merge(parts, columns: int = 1):
    got = [_unpack(x.as_buffer(), columns) for x in parts]
    if not got:
        return np.zeros(0, np.uint64), np.zeros((columns, 0), np.int64)
    return _sum(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got], axis=1))


def _split(kind: int, buckets, pack, *columns):
    """Rows (kind, bucket, packed) of columns whose ``buckets`` ascend."""
    first = np.append(_heads(buckets), len(buckets))
    return [(kind, int(buckets[i]), pack(*(c[..., i:j] for c in columns))) for i, j in zip(first, first[1:])]


class Model:
    """A model's sorted hash arrays, memory-mapped where the shared folder is mounted.

    ``bits`` name a word's bucket, ``context_bits`` a context's; ``present`` holds the buckets of
    either that have a file. A file that should be there and isn't is an error. Where the folder is
    a store that can't be mapped, files are read, and the least recently used go beyond ``most`` bytes.
    """

    def __init__(self, folder: str, bits: int, context_bits: int, present: dict, most: int = 1 << 29):
        self.folder, self.bits, self.present, self.most = folder, {"word": bits, "pair": bits, "context": context_bits}, present, most
        self.open: OrderedDict = OrderedDict()
        self.held = 0

    def arrays(self, kind: str, b: int):
        """(keys, columns) of one bucket. A column is (counts of a byte, places, values): a count of
        255 or more is 255, and found by its place among the values."""
        if (kind, b) not in self.open:
            fs_, path = filesystem(f"{self.folder}/{kind}-{b}")
            mapped = fs_.type_name == "local"
            raw = np.memmap(path, np.uint8, "r") if mapped else np.frombuffer(fs_.open_input_file(path).read(), np.uint8)
            n, width, bits = (int(x) for x in raw[:24].view(np.uint64))
            at, columns = 24 + 8 * n, []
            for _ in range(width):
                m = int(raw[at : at + 8].view(np.uint64)[0])
                wide = raw[at + 8 : at + 8 + 16 * m].view(np.int64)
                at += 8 + 16 * m
                columns.append((raw[at : at + n], wide[:m], wide[m:]))
                at += -(-n // 8) * 8
            self.open[kind, b] = raw[24 : 24 + 8 * n].view(np.uint64), columns, bits, 0 if mapped else len(raw)
            self.held += self.open[kind, b][3]
            while self.held > self.most and len(self.open) > 1:
                self.held -= self.open.popitem(last=False)[1][3]
        self.open.move_to_end((kind, b))
        return self.open[kind, b][:3]

    def find(self, kind: str, words: np.ndarray, columns: int, rank=None, code=None) -> np.ndarray:
        """The values of ``words``, which ascend, and behind them their ranks in their buckets; zeros
        and rank -1 where one isn't there. Bigrams are found by the second word's rank and the
        first's code, words and contexts by their hashes."""
        out = np.zeros((columns + 1, len(words)), np.int64)
        out[columns] = -1
        bucket = _bucket(words, self.bits[kind])
        first = np.append(_heads(bucket), len(words))
        there = self.present["context" if kind == "context" else "word"]
        for i, j in zip(first, first[1:]):
            b = int(bucket[i])
            if not there[b >> 3] >> (b & 7) & 1:
                continue
            have, values, bits = self.arrays(kind, b)
            if not len(have):
                continue
            if rank is None:
                keys, known = words[i:j], True
            else:
                keys, known = _key(rank[i:j].astype(np.uint64), code[i:j], bits), rank[i:j] >= 0
            p = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            hit = np.flatnonzero((have[p] == keys) & known)
            out[columns, i + hit] = p[hit]
            for c in range(columns):
                small, place, wide = values[c]
                x = small[p[hit]].astype(np.int64)
                big = np.flatnonzero(x == 255)
                x[big] = wide[np.searchsorted(place, p[hit[big]])]
                out[c, i + hit] = x
        return out


def _key(rank: np.ndarray, code: np.ndarray, bits: int) -> np.ndarray:
    """A bigram within its bucket: the second word's rank there, and ``bits`` bits of the first's code."""
    return rank << np.uint64(bits) | code >> np.uint64(48 - bits)


def _bucket(words: np.ndarray, bits: int) -> np.ndarray:
    """The bucket that a word's hash belongs to: its upper bits."""
    return (words >> np.uint64(64 - bits)).astype(np.int64)


@lru_cache(maxsize=1)
def model(folder: str, bits: int, context_bits: int, words: bytes, contexts: bytes) -> Model:
    return Model(folder, bits, context_bits, {"word": words, "context": contexts})


def _save(folder: str, kind: str, b: int, keys, *values, bits: int = 48) -> None:
    parts = [np.array([len(keys), len(values), bits], np.uint64).tobytes(), keys.astype(np.uint64).tobytes()]
    for v in values:
        v = v.astype(np.int64)
        big = np.flatnonzero(v >= 255)
        parts += [np.array([len(big)], np.uint64).tobytes(), big.astype(np.int64).tobytes(), v[big].tobytes(), np.minimum(v, 255).astype(np.uint8).tobytes(), bytes(-len(v) % 8)]
    write_file(f"{folder}/{kind}-{b}", *parts)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many have counts 1 to 4."""
    n1, n2, n3, n4 = (max(1.0, float(x)) for x in n)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k - 0.05, max(0.05, d)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def train(docs: DataFrame, *, least: int = 1, flush_tokens: int = 1 << 21, bucket_bytes: int = 2 << 20) -> tuple:
    """Count words and bigrams of ``docs`` (doc_id, text) and write the model to the shared folder.

    All bigrams are counted and enter the discounts and the lower order; those seen fewer than
    ``least`` times, none by default, are then left to the lower order, as count cutoffs do. Tasks
    sum their own counts before the shuffle, buckets of words, about one for each ``bucket_bytes`` of
    text, are summed apart, and each is a file of sorted hashes; the driver gets a row of totals
    and a bitmap of the buckets from each task.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, int(size // bucket_bytes).bit_length())
    context_bits = bits - 4
    folder = shared_folder(docs.sparkSession, "kneser-ney")

    def count(batches):
        held, size = [], 0

        def flush():
            w, many = (np.concatenate(x) for x in zip(*held))
            held.clear()
            words, iw, ih = _bigrams(w, many)
            del w
            own = np.bincount(iw, minlength=len(words))
            k = np.flatnonzero(own)
            rows = _split(0, _bucket(words[k], bits), _pack, words[k], own[k][None])
            pairs, c = np.unique(iw * np.int64(len(words)) + ih, return_counts=True)
            k = words[pairs // len(words)]
            rows += _split(1, _bucket(k, bits), _pack_pairs, k, _codes(words[pairs % len(words)]), c)
            return _table(rows).to_batches()[0]

        for whole in batches:
            for b in byte_batches(whole):
                held.append(_tokens(b.column(1)))
                size += len(held[-1][0])
                if size >= flush_tokens:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def total(key, t):
        b = key[0].as_py()
        kinds = t.column("kind").to_numpy()
        data = t.column("data").combine_chunks()
        w, (c,) = _merge([data[int(i)] for i in np.flatnonzero(kinds == 0)])
        hold = min(48, 64 - max(1, len(w) - 1).bit_length())
        parts = [_unpack_pairs(data[int(i)].as_buffer()) for i in np.flatnonzero(kinds == 1)]
        # every token follows another or the beginning, so its word is among the bucket's
        keys = np.concatenate([_key(np.repeat(np.searchsorted(w, x).astype(np.uint64), n), code, hold) for x, n, code, _ in parts])
        order = np.argsort(keys)
        first = _heads(pairs := keys[order])
        pairs, pc = pairs[first], np.add.reduceat(np.concatenate([p[3] for p in parts])[order], first)
        before = np.concatenate([p[2] for p in parts])[order[first]]
        found = np.bincount((pairs >> np.uint64(hold)).astype(np.int64), minlength=len(w))
        _save(folder, "word", b, w, c, found)
        kept = pc >= least
        _save(folder, "pair", b, pairs[kept], pc[kept], bits=hold)
        rows = [(-1, b, np.array([c.sum(), len(w), *((pc == k).sum() for k in (1, 2, 3, 4)), *((found == k).sum() for k in (1, 2, 3, 4)), (found >= 3).sum(), found.sum()], "<i8").tobytes())]
        if kept.any():
            h, x = before[kept] << _16, pc[kept]
            h, sums = _sum(h, np.stack([x, x == 1, x == 2, x >= 3]).astype(np.int64))
            rows += _split(0, _bucket(h, context_bits), _pack, h, sums)
        return _table(rows)

    def contexts(key, t):
        h, sums = _merge(t.column("data").combine_chunks(), 4)
        _save(folder, "context", b := key[0].as_py(), h, *sums)
        return _table([(-1, b, b"")])

    def gather(batches):
        """One row a task: the sum of its totals, and the bitmap of its buckets."""
        stats, there = np.zeros(12, np.int64), bytearray(1 << bits >> 3)
        for t in batches:
            for b, data in zip(t.column(1).to_pylist(), t.column(2).to_pylist()):
                there[b >> 3] |= 1 << (b & 7)
                if data:
                    stats += np.frombuffer(data, "<i8")
        yield _table([(-1, 0, stats.tobytes() + there)]).to_batches()[0]

    def gathered(rows):
        stats, there = np.zeros(12, np.int64), np.zeros(1 << bits >> 3, np.uint8)
        for r in rows.coalesce(64).mapInArrow(gather, ROWS).select("data").toLocalIterator():  # one bitmap at a time
            stats += np.frombuffer(r[0][:96], "<i8")
            there |= np.frombuffer(r[0][96:], np.uint8)
        return [int(x) for x in stats], there.tobytes()

    totals = stash(docs.mapInArrow(count, ROWS).groupBy("bucket").applyInArrow(total, ROWS), "kneser-ney-totals")
    done = stash(totals.where("kind >= 0").groupBy("bucket").applyInArrow(contexts, ROWS), "kneser-ney-contexts")
    stats, words = gathered(totals.where("kind = -1"))
    return folder, bits, context_bits, words, gathered(done)[1], stats


ROWS = "kind int, bucket int, data binary"


def _table(rows) -> pa.Table:
    kinds, buckets, data = zip(*rows)
    return pa.table({"kind": pa.array(kinds, pa.int32()), "bucket": pa.array(buckets, pa.int32()), "data": pa.array([bytes(x) for x in data], pa.binary())})


def scores(docs: DataFrame, *, text: str = "text", key: str = "doc_id", folds: int = 5, held_out: int = 1, least: int = 1, batch_bytes: int = 8 << 20) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each input row.

    The model learns from rows whose crc32(key as text) mod ``folds`` isn't ``held_out``, and from
    those of null keys. p(w|h) = max(c(hw) - D, 0) / c(h) + g(h) p(w), with p(w) from the number of
    different words before w, discounted likewise and interpolated with 1 / (V + 1); g(h) is what
    the kept bigrams of h leave. Words are told apart by 64-bit hashes, as contexts by 48 bits of them.
    Workers look up each batch's distinct words and bigrams, sorted, in the mapped arrays, so the
    model takes no memory of theirs and text isn't shuffled.
    Null and empty texts hold the end alone. Repeated rows count and score as rows of their own.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = tagged(docs, text, key).withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False)))
    *where, stats = train(rows.where("not held_out").select("doc_id", "text"), least=least)
    bits = where[1]
    total, types = stats[:2]
    d, low = (np.array([0.0, *_discounts(stats[i : i + 4])]) for i in (2, 6))
    three, pairs = stats[10], max(1, stats[11])
    rest = (low[1] * stats[6] + low[2] * stats[7] + low[3] * three) / pairs if stats[11] else 1.0

    def run(batches):
        at = model(*where)
        docs_seen = at.find("word", np.array([END]), 1)[0, 0]
        for whole in batches:
            for b in byte_batches(whole, most=batch_bytes):
                w, many = _tokens(b.column(1))
                words, iw, ih = _bigrams(w, many)
                del w
                c, follows, rank = at.find("word", words, 2)
                lower = np.maximum(follows - low[np.minimum(follows, 3)], 0) / pairs + rest / (types + 1)
                seen = np.where(words == BEGIN, docs_seen, np.where(words == END, 0, c)).astype(float)
                mass, k1, k2, k3, _ = at.find("context", _codes(words) << _16, 4)
                left = 1 - (mass - d[1] * k1 - d[2] * k2 - d[3] * k3) / np.maximum(seen, 1)
                left = np.where(seen > 0, np.clip(left, 1e-9, 1), 1.0)
                row = np.repeat(np.arange(b.num_rows, dtype=np.int32), many)
                sums = lambda x: np.bincount(row, x[iw], b.num_rows)
                known, base = sums(c > 0).astype(np.int64), sums(np.log10((c + 0.5) / (total + 0.5 * (types + 1))))
                one, iw = np.unique(iw * np.int64(len(words)) + ih, return_inverse=True)  # distinct bigrams in the order of their second words
                second, h = one // len(words), one % len(words)
                del one, ih
                both = at.find("pair", words[second], 1, rank[second], _codes(words[h]))[0]
                p = np.where(both > 0, (both - d[np.minimum(both, 3)]) / np.maximum(np.maximum(seen[h], both), 1), 0.0) + left[h] * lower[second]
                score = sums(np.log10(p))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(many), pa.array(known), pa.array(np.full(b.num_rows, total, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
