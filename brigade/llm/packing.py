"""Operator 9: packing token ids into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .shared import byte_batches, documents, tagged

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def karmarkar_karp(sizes, k: int) -> list[list[int]]:
    """Deal items into ``k`` parts with near-equal sums: the two partial partitions with the
    largest imbalance are merged again and again, large sums of one with small sums of the other.

    A partial partition holds only its parts that have items, by ascending sum, each a tree of item
    numbers: memory grows with the items, not with items times ``k``.
    """
    if k <= 1 or not len(sizes):
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    heap = [(-int(s), i, np.array([s], np.int64), [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, ta = heapq.heappop(heap)
        _, _, b, tb = heapq.heappop(heap)
        # beside empty parts nothing is added; where both have more than k, their smallest meet, in opposite order
        both = max(0, len(a) + len(b) - k)
        sums = np.concatenate([a[:both] + b[:both][::-1], a[both:], b[both:]])
        trees = list(zip(ta[:both], tb[:both][::-1])) + ta[both:] + tb[both:]
        order = np.argsort(sums, kind="stable")
        sums, trees = sums[order], [trees[i] for i in order]
        if len(sums) == k:
            sums = sums - sums[0]  # only differences matter from here on
        heapq.heappush(heap, (-int(sums[-1]), tie, sums, trees))
        tie += 1
    out = [_leaves(t) for t in heap[0][3]]
    return [[] for _ in range(k - len(out))] + out


def _leaves(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo += t
        else:
            out.append(t)
    return out


def windows(sizes, capacity: int) -> list[list[int]]:
    """Items dealt to windows of at most ``capacity`` in sum; no item may be above it.

    The count starts at ceil(total/capacity) and rises whenever a window of the differencing exceeds
    the capacity, by the share by which the largest does, as windows are near-equal; with as many
    windows as items each is alone, so it ends.
    """
    k = max(1, -(-int(sum(sizes)) // capacity))
    while True:
        dealt = karmarkar_karp(sizes, k)
        over = max(sum(int(sizes[i]) for i in p) for p in dealt) - capacity
        if over <= 0:
            return [p for p in dealt if p]
        k += max(1, k * over // capacity)


def _cut(pieces, capacity: int, end_id: int):
    """((start, crc) of each full window, the rest's ids, how many ids in all) of a document's ids, which come in pieces."""
    full, rest, start = [], np.zeros(0, "<u4"), 0
    for ids in chain(pieces, [[end_id]]):
        rest = np.concatenate([rest, np.array(ids, "<u4")])
        n = len(rest) // capacity * capacity
        full += [(start + i, zlib.crc32(rest[i : i + capacity].tobytes())) for i in range(0, n, capacity)]
        rest, start = rest[n:].copy() if n else rest, start + n
    return full, rest, start + len(rest)


def pack(docs: DataFrame, *, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, group_tokens: int = 1 << 19, group_docs: int = 1 << 17, small: int = 64) -> DataFrame:
    """One row for each piece of a document: where it starts, how long it is, and its place.

    Each task tokenises its own split and packs groups of about ``group_tokens`` tokens and of at
    most ``group_docs`` documents, so no row is shuffled; sequence ids are the task's number times
    2**33 plus a count, so a repeated task gives the same ids. Documents longer than the capacity
    first give full windows, as their ids come from stretches of the text; what is left of each
    document goes through the differencing whole, documents of fewer than ``small`` tokens in runs of
    about so many, as one item: a group has at most 2 * group_tokens / small items or so, and memory
    beside the text is bounded where it has safe places to cut (``bpe.safe_pieces``).
    Null or empty texts hold the end id alone. Repeated rows or keys are packed as separate
    documents. Extra columns are ignored; an empty table gives an empty result.
    """
    path = tokenizer or bpe.default_path()

    def run(batches):
        enc, base = bpe.encoder(path), TaskContext.get().partitionId() << 33
        made = 0
        held: list[tuple[int, np.ndarray, int, int]] = []  # doc_id, ids, start of the rest, tokens of the document
        rows: list[tuple] = []
        waiting = 0

        def crc(ids):
            return zlib.crc32(ids.tobytes())

        def flush():
            nonlocal made, held, waiting
            runs, size = [], small  # items: runs of documents
            for i, h in enumerate(held):
                n = len(h[1])
                if n < small and size < small:
                    runs[-1].append(i)
                    size += n
                else:
                    runs.append([i])
                    size = n if n < small else small
            sizes = [sum(len(held[i][1]) for i in r) for r in runs]
            for w in windows(sizes, capacity):
                at = 0
                for i in sorted(i for item in w for i in runs[item]):
                    doc, ids, first, total = held[i]
                    rows.append((doc, first, len(ids), crc(ids), total, base + made, at))
                    at += len(ids)
                made += 1
            held, waiting = [], 0

        def out():
            cols = list(zip(*rows)) if rows else [[]] * 7
            names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for whole in batches:
            for b in byte_batches(whole):
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    full, rest, total = _cut(map(enc.ids, bpe.safe_pieces(t)), capacity, end_id)
                    for start, sum_ in full:
                        rows.append((doc, start, capacity, sum_, total, base + made, 0))
                        made += 1
                    if len(rest):
                        held.append((doc, rest, total - len(rest), total))
                        waiting += len(rest)
                    if waiting >= group_tokens or len(held) >= group_docs:
                        flush()
                        yield out()
                if rows:
                    yield out()
        flush()
        if rows:
            yield out()

    return tagged(docs, text, key).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
