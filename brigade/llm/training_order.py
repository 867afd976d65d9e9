"""Operator 6: token ids written in training order, as shards of fixed stride."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import byte_batches, documents, filesystem, shared_folder, stash, tagged, write_file
from .words import mix

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, slot long, offset long, shard long, byte_offset long"


#: So many sequences of a task are compressed together in the stash; each goes alone through the shuffle.
FRAME = 64


def _bytes(rows: list[tuple]) -> bytes:
    """Integers of several rows, bytes of one place together, which compresses well."""
    return np.array(rows, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    """The rows of five integers again."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1, 5)


def permute(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1: a Feistel network over the next even power of two, walked on
    along its cycle while a value is outside."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> half, out[todo] & mask
        for r in range(rounds):
            a, b = b, a ^ (mix(b + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % 2**64)) & mask)
        out[todo] = a << half | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def materialise(docs: DataFrame, folder: str, *, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, length: int = 2048, per_shard: int = 1024, end_id: int = 1, seed: int = 20240229) -> DataFrame:
    """Write shards ``folder``/shard-NNNNNN.bin and return a row for each piece of a document in them.

    Each task joins its documents' ids, an end id after each, and cuts them into sequences of
    ``length``, the last one filled up with end ids. They are written to the shared folder under the
    task's number and their own; counts of each task then give every sequence its number over all,
    whose place under the keyed permutation is its slot. Sequence s is
    at byte (s mod per_shard) * length * width of shard s div per_shard: a reader finds any step of
    training without an index. Range partitions of shards, each of whole shards, write them: a shard
    is written whole and then renamed, and is left alone when it is there already with the same
    bytes, so an interrupted run goes on where it stopped. Numbers follow the order of the input's
    splits, so that holds for the same files read with the same split sizes; with others every slot
    may be another one's and shards are written anew. A shard short of sequences is an error.

    Null or empty texts hold the end id alone. Repeated rows or keys are documents of their own.
    Extra columns are ignored; an empty table writes nothing and gives an empty result.
    """
    path = tokenizer or bpe.default_path()
    rows = tagged(docs, text, key)

    width = 2 if bpe.encoder(path).size <= 1 << 16 else 4
    kind = "<u2" if width == 2 else "<u4"

    def cut(batches):
        enc, task, made = bpe.encoder(path), TaskContext.get().partitionId(), 0
        ids, pieces, held, out = [], [], [], []
        pack = zstandard.ZstdCompressor(level=3)

        def put(part):
            data = np.full(length, end_id, kind)
            data[: len(part)] = part
            held.append((data.tobytes(), _bytes(pieces)))
            pieces.clear()
            if len(held) == FRAME:
                frame()

        def frame():
            nonlocal made
            sizes = np.array([len(p) for _, p in held], "<i8").tobytes()
            out.append((made, len(held), pack.compress(sizes + b"".join(x for x, _ in held) + b"".join(p for _, p in held))))
            made += len(held)
            held.clear()

        def batch():
            cols = [pa.array([task] * len(out), pa.int32()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=["task", "i", "n", "data"])

        for whole in batches:
            for b in byte_batches(whole):
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    start, opened = 0, len(ids)  # of the open sequence's piece of this document
                    for new in chain(map(enc.ids, bpe.safe_pieces(t)), [[end_id]]):
                        at = 0
                        while at < len(new):
                            take = min(length - len(ids), len(new) - at)
                            ids += new[at : at + take]
                            at += take
                            if len(ids) == length:
                                pieces.append((-1 if doc is None else doc, int(doc is None), start, length - opened, opened))
                                start, opened = start + length - opened, 0
                                put(ids)
                                ids = []
                                if len(out) >= 64:
                                    yield batch()
                    if len(ids) > opened:
                        pieces.append((-1 if doc is None else doc, int(doc is None), start, len(ids) - opened, opened))
                if out:
                    yield batch()
        if ids:
            put(ids)
        if held:
            frame()
        if out:
            yield batch()

    def place(batches):
        pack, unpack = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        for b in batches:
            for task, i, n, data in zip(*(c.to_pylist() for c in b.columns)):
                raw = unpack.decompress(data)
                at = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n))]) + n * (8 + length * width)
                parts_ = [pack.compress(raw[8 * n + j * length * width : 8 * n + (j + 1) * length * width] + raw[at[j] : at[j + 1]]) for j in range(n)]
                slots = permute(firsts[task] + i + np.arange(n), total, seed)
                shards = slots // per_shard
                yield pa.RecordBatch.from_arrays([pa.array((shards * parts // n_shards).astype(np.int32)), pa.array(shards), pa.array(slots), pa.array(parts_, pa.binary())], names=["part", "shard", "slot", "data"])

    def write(batches):
        held, now = [], None
        unpack = zstandard.ZstdDecompressor()

        def shard():
            n = min(per_shard, total - now * per_shard)
            data = b"".join(x[1] for x in held)
            name = f"{folder}/shard-{now:06d}.bin"
            fs_, at = filesystem(name)
            if len(held) != n:
                raise RuntimeError(f"shard {now}: {len(held)} sequences of {n}")
            if not (fs_.get_file_info(at).is_file and fs_.open_input_file(at).read() == data):
                write_file(name, data)
            rows = []
            for slot, ids, pieces in held:
                seq = np.frombuffer(ids, kind).astype("<u4")
                for doc, null, start, size, offset in pieces.tolist():
                    rows.append((None if null else doc, start, size, zlib.crc32(seq[offset : offset + size].tobytes()), slot, offset, now, slot % per_shard * length * width))
            names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and row[0] != now:
                    yield shard()
                    held.clear()
                now = row[0]
                x = unpack.decompress(row[2])
                held.append((row[1], x[: length * width], _numbers(x[length * width :])))
        if held:
            yield shard()

    sequences = stash(rows.mapInArrow(cut, "task int, i long, n int, data binary"), "sequences")
    total, firsts = 0, {}
    for task, n in sorted(map(tuple, sequences.groupBy("task").agg(F.sum("n")).collect())):
        firsts[task] = total
        total += n
    n_shards = max(1, -(-total // per_shard))
    # whole shards to a task, and no more than 64 of them, whatever the session's number of partitions
    parts = min(n_shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_shards // 64)))
    dealt = sequences.mapInArrow(place, "part int, shard long, slot long, data binary").repartitionById(parts, F.col("part")).select("shard", "slot", "data")
    return dealt.sortWithinPartitions("slot").mapInArrow(write, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), shared_folder(spark, "training-order"))
