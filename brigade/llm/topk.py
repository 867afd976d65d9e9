"""Operator 5: exact top-k inner products by a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import stash

#: A task takes at most so many blocks of rows and of queries, and fewer while there are fewer tasks than ``TASKS``.
SPAN, QUERY_SPAN, TASKS = 16, 64, 64
SCHEMA = "query_id long, vec_id long, score long"
BLOCK = "len int, n_queries int, rb int, ids binary, x binary, index binary, bits int, cut int, sliced boolean, copies binary"
BLOCK_ARROW = [("len", pa.int32()), ("n_queries", pa.int32()), ("rb", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("index", pa.binary()), ("bits", pa.int32()), ("cut", pa.int32()), ("sliced", pa.bool_()), ("copies", pa.binary())]


def _slices(x: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps of a matrix of small non-negative integers: [attribute, bit, word of 64 rows]."""
    rows = -(-len(x) // 64) * 64
    full = np.zeros((rows, x.shape[1]), np.uint32)
    full[: len(x)] = x
    out = np.empty((x.shape[1], bits, rows // 64), np.uint64)
    for b in range(bits):
        out[:, b] = np.ascontiguousarray(np.packbits((full >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")).view(np.uint64)
    return out


def _add(planes: list, weight: int, bitmap: np.ndarray) -> None:
    """Add bitmap * 2**weight to a carry-save sum: three bitmaps of a weight become one and a carry."""
    while True:
        while len(planes) <= weight:
            planes.append([])
        held = planes[weight]
        held.append(bitmap)
        if len(held) < 3:
            return
        a, b, c = held
        half = a ^ b
        planes[weight] = [half ^ c]
        bitmap, weight = (a & b) | (half & c), weight + 1


def _settle(planes: list) -> list[np.ndarray]:
    """One bitmap for each weight, from the least significant."""
    out, carry = [], None
    for held in planes:
        parts = held + ([carry] if carry is not None else [])
        carry = None
        if len(parts) == 3:
            a, b, c = parts
            out.append(a ^ b ^ c)
            carry = (a & b) | ((a ^ b) & c)
        elif len(parts) == 2:
            out.append(parts[0] ^ parts[1])
            carry = parts[0] & parts[1]
        else:
            out.append(parts[0] if parts else None)
    if carry is not None:
        out.append(carry)
    return out


def _kth(planes: np.ndarray, live: np.ndarray, k: int) -> int:
    """The k-th largest sum of the live rows, decided from the most significant slice downward."""
    value, among, need = 0, live, k
    for w in range(len(planes) - 1, -1, -1):
        ones = among & planes[w]
        n = int(np.bitwise_count(ones).sum())
        if n >= need:
            among, value = ones, value | 1 << w
        else:
            need -= n
            among = among & ~planes[w]
    return value


def _at_least(planes: np.ndarray, live: np.ndarray, bound: int) -> np.ndarray:
    """Bitmap of the live rows whose sum is at least ``bound``."""
    if bound <= 0:
        return live
    if bound >> len(planes):
        return np.zeros_like(live)
    more, equal = np.zeros_like(live), live
    for w in range(len(planes) - 1, -1, -1):
        if bound >> w & 1:
            equal = equal & planes[w]
        else:
            more = more | (equal & planes[w])
            equal = equal & ~planes[w]
    return more | equal


class Block:
    """The bit-sliced index of a block of rows: attributes, shifted to start from 0 and cut to their
    ``kept_bits`` highest bits, as bitmaps, beside the whole integers that settle boundary rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kept_bits: int = 6):
        self.ids, self.x = ids, x
        low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
        self.most = max(abs(low), abs(high))
        base = x.min(axis=0) if len(x) else np.zeros(x.shape[1], np.int64)
        # a span beyond 62 bits isn't sliced: every row of such a block is settled exactly
        self.sliced = high - low < 1 << 62
        span = int((x - base).max()) if x.size and self.sliced else 0
        self.cut = max(0, span.bit_length() - kept_bits)
        self.bits = max(1, span.bit_length() - self.cut)
        self.index = _slices((x - base) >> self.cut, self.bits) if self.sliced else np.zeros((x.shape[1], 1, -(-len(x) // 64)), np.uint64)

    def pack(self) -> tuple:
        return self.ids.tobytes(), self.x.tobytes(), self.index.tobytes(), self.bits, self.cut, self.sliced

    @classmethod
    def unpack(cls, ids, x, index, bits: int, cut: int, sliced: bool) -> Block:
        self = cls.__new__(cls)
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(x, np.int64).reshape(len(self.ids), -1)
        self.most = max(abs(int(self.x.min())), abs(int(self.x.max()))) if self.x.size else 0
        self.bits, self.cut, self.sliced = bits, cut, sliced
        self.index = np.frombuffer(index, np.uint64).reshape(self.x.shape[1], bits, -(-len(self.ids) // 64))
        return self

    def top(self, query_ids: np.ndarray, q: np.ndarray, k: int, group: int = 64):
        """For each query its ``k`` best rows, as (query_id, place, score) arrays.

        A score's main part is the sum of slices times the query's bits, the query's negative
        attributes taken with complemented slices, so that nothing is subtracted. What the cut bits
        can add is bounded for each query: rows within it of the k-th sum are resolved exactly.
        """
        widest = max(abs(int(q.min())), abs(int(q.max()))) if q.size else 0
        wide = not self.sliced or (self.most + 1) * (widest + 1) * max(1, q.shape[1]) >= 1 << 62
        out = []
        inverse = ~self.index
        live = _slices(np.ones((len(self.x), 1), np.uint32), 1)[0, 0]
        for g in range(0, len(q), group):
            part = q[g : g + group]
            stack = None if wide else self._sums(np.abs(part), part < 0, inverse, len(live))
            for i in range(len(part)):
                mine = live.copy()
                for r in np.flatnonzero(self.ids == query_ids[g + i]):
                    mine[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
                n = int(np.bitwise_count(mine).sum())
                if not n:
                    continue
                if stack is not None:
                    # exact = 2**cut * (sum - top * |negatives|) + q.base + rest, |rest| below 2**cut * |q| in all
                    slack = -(-int(np.abs(part[i]).sum()) * ((1 << self.cut) - 1) // (1 << self.cut))
                    edge = _kth(stack[:, i], mine, min(k, n)) - slack
                    mine = _at_least(stack[:, i], mine, edge)
                rows = np.flatnonzero(np.unpackbits(mine.view(np.uint8), bitorder="little")[: len(self.x)])
                if wide:  # sums may leave 64 bits: whole numbers of any size, held to the range of a long
                    sums = (sum(a * b for a, b in zip(x, part[i].tolist())) for x in self.x[rows].tolist())
                    exact = np.array([max(-(1 << 63), min((1 << 63) - 1, y)) for y in sums], np.int64)
                else:
                    exact = self.x[rows] @ part[i]
                best = np.lexsort((self.ids[rows], ~exact))[:k]
                out.append((np.full(len(best), query_ids[g + i]), rows[best], exact[best]))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3

    def _sums(self, m: np.ndarray, neg: np.ndarray, inverse: np.ndarray, words: int) -> np.ndarray:
        """[weight, query, word]: the slices of every row's sum."""
        planes: list = []
        for d in range(m.shape[1]):
            for b in range(int(m[:, d].max()).bit_length()):
                has = m[:, d] >> b & 1 == 1
                plus = np.where(has & ~neg[:, d], ~np.uint64(0), np.uint64(0))[:, None]
                minus = np.where(has & neg[:, d], ~np.uint64(0), np.uint64(0))[:, None]
                for s in range(self.bits):
                    _add(planes, b + s, self.index[d, s] & plus | inverse[d, s] & minus)
        sums = _settle(planes)
        zero = np.zeros((len(m), words), np.uint64)
        return np.stack([p if p is not None else zero for p in sums] or [zero])


def top_k(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", k: int = 5, query_every: int = 50, scale: float = 256.0, row_block: int = 4096, query_block: int = 1024) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Queries are the rows whose key is divisible by ``query_every``; every row but those of the
    query's own key is a candidate. Attributes become floor(scale * x). Rows are dealt into blocks by
    a hash of key and vector; each block's slices are built once and written to the shared folder.
    Queries are dealt into blocks too, and each of those meets each block of rows: a task takes a
    group of blocks of either, at most ``SPAN`` of rows and ``QUERY_SPAN`` of queries, so a block is sent
    once for each group of the other side. Nothing is broadcast, and a task's answer is at most
    ``k`` rows for each query.

    Vectors that are null or hold null or non-finite components take no part, nor do null keys. A
    query meets the vectors of its own length; those of no components all score 0. Quantised
    components are held to the range of a long, and so are scores, which are exact within it.
    Ties go to the smaller key. Repeated rows (key and vector the same) are counted once in a block
    and come out as candidates of their own, except to queries of that key; a query key of several
    vectors is asked once, with its smallest (a shorter one first). An empty table gives an empty result.
    """
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    # copies of a row meet before the shuffle, so a hot key is at most a row for each vector and task
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("len", F.size("v"))
    rows = stash(rows, "vectors")
    asked = rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min(F.struct("len", "v")).alias("x")).select("vec_id", "x.len", "x.v")
    blocks_of = lambda df, size, name: df.groupBy("len").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = stash(blocks_of(rows, row_block, "n_rows").join(blocks_of(asked, query_block, "n_queries"), "len"), "block-counts")
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    dealt = rows.join(sizes, "len").groupBy("len", "n_queries", deal("n_rows", "vec_id", "v").alias("rb")).agg(F.collect_list(F.struct("vec_id", "v", "copies")).alias("r"))

    def build(batches):
        for t in batches:
            for length, n, rb, r in zip(*t.columns):
                ids, x, copies = _matrix(r.values, length.as_py())
                ids_, x_, index, bits, cut, sliced = Block(ids, x).pack()
                yield pa.RecordBatch.from_pydict({"len": [length.as_py()], "n_queries": [n.as_py()], "rb": [rb.as_py()], "ids": [ids_], "x": [x_], "index": [index], "bits": [bits], "cut": [cut], "sliced": [sliced], "copies": [copies.tobytes()]}, pa.schema(BLOCK_ARROW))

    blocks = stash(dealt.select("len", "n_queries", "rb", "r").mapInArrow(build, BLOCK), "sliced-index")
    queries = asked.join(sizes, "len").groupBy("len", "n_rows", "n_queries", deal("n_queries", "vec_id").alias("qb")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    # blocks of rows meet blocks of queries in groups, so that what is sent grows with the groups and not with the blocks
    n_rows, n_queries = F.col("n_rows"), F.col("n_queries")
    row_span = F.least(F.lit(SPAN), F.ceil(n_rows / TASKS)).cast("int")
    row_groups = F.ceil(n_rows / row_span).cast("int")
    query_span = F.greatest(F.lit(1), F.least(F.lit(QUERY_SPAN), F.floor(row_groups * n_queries / TASKS))).cast("int")
    query_groups = F.ceil(n_queries / query_span).cast("int")
    left = blocks.join(sizes, ["len", "n_queries"]).withColumn("rg", F.floor(F.col("rb") / row_span)).withColumn("qg", to_all(query_groups))
    right = queries.withColumn("qg", F.floor(F.col("qb") / query_span)).withColumn("rg", to_all(row_groups))
    meet = lambda df, *c: df.select("len", F.col("rg").cast("int").alias("rg"), F.col("qg").cast("int").alias("qg"), *c).groupBy("len", "rg", "qg")

    def run(key, rows, asks):
        parts = []
        for q in (x for c in asks["q"].chunks for x in c):
            ids, x, _ = _matrix(q.values, key[0].as_py())
            found = []
            for r in rows.to_batches(max_chunksize=1):
                of = {n: r.column(n)[0] for n in r.schema.names}
                block = Block.unpack(*(of[n].as_buffer() for n in ("ids", "x", "index")), of["bits"].as_py(), of["cut"].as_py(), of["sliced"].as_py())
                qi, place, score = block.top(ids, x, k)
                times = np.minimum(np.frombuffer(of["copies"].as_buffer(), np.int64)[place], k)
                found.append([np.repeat(c, times).astype(np.int64) for c in (qi, block.ids[place], score)])
            parts.append(_best(*(np.concatenate(c) for c in zip(*found)), k) if found else [np.zeros(0, np.int64)] * 3)
        return pa.table([pa.array(np.concatenate(c) if parts else [], pa.int64()) for c in (zip(*parts) if parts else [[]] * 3)], names=["query_id", "vec_id", "score"])

    best = meet(left, "ids", "x", "index", "bits", "cut", "sliced", "copies").cogroup(meet(right, "q")).applyInArrow(run, SCHEMA)
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
    """Each query's ``k`` best of rows from several blocks."""
    order = np.lexsort((ids, ~scores, query_ids))
    q = query_ids[order]
    kept = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
    return [c[kept] for c in (query_ids, ids, scores)]


def _matrix(block, length: int) -> tuple:
    """(ids, matrix, copies) of a list of structs, by id and vector."""
    ids = block.field("vec_id").to_numpy()
    x = block.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), length)
    copies = block.field("copies").to_numpy() if block.type.get_field_index("copies") >= 0 else np.ones(len(ids), np.int64)
    order = np.lexsort((*x.T[::-1], ids))
    return ids[order], np.ascontiguousarray(x[order]), copies[order]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
