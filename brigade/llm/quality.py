"""Operator 10: quality classifier, Naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import byte_batches, documents, tagged
from .words import LOWER, buffers, hashes, mix, spans

BITS = 18
#: Texts of fewer n-grams are scaled as if they had so many: a few n-grams tell little, and the bias decides.
LEAST = 64
#: Square of the constant input; a large one leaves the bias nearly free of the penalty on weights.
FREE = 25.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_PAIR, _TRIPLE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _shapes(data, starts, ends, h, bound):
    """A symbol for the look of each word: same as the one before, case, last byte's kind, length."""
    kind = np.zeros(256, np.uint8)
    kind[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
    kind[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
    kind[[*b"0123456789"]] = 3
    kind[[*b".,;:"]] = 4
    kind[[*b"!?"]] = 5
    kind[[*b"*#$%&|<>/\\_=+~^@"]] = 6
    kind[128:] = 7
    low = np.add.reduceat((kind[data] == 1).astype(np.int32), starts) if len(starts) else np.zeros(0, np.int32)
    lens = ends - starts
    same = np.zeros(len(h), np.uint64)
    same[1:] = (h[1:] == h[:-1]) & ~bound[1:]
    size = np.minimum(np.log2(lens + 1).astype(np.uint64), np.uint64(6))
    first, last = kind[data[starts]], kind[data[ends - 1]]
    return same + np.uint64(2) * (low == 0) + np.uint64(4) * first.astype(np.uint64) + np.uint64(32) * last.astype(np.uint64) + np.uint64(256) * size


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each row, as (row << BITS | n-gram) in order, and row bounds.

    Indicators only: 3-grams of bytes, 1- and 2-grams of lower-cased words, 1- to 3-grams of the
    words' looks. Whole texts are read.
    """
    data, offs = buffers(col)
    n = len(offs) - 1
    parts = []

    def add(h, rows, salt):
        f = mix(h + np.uint64(salt)) & np.uint64((1 << BITS) - 1)
        parts.append((rows.astype(np.int64) << BITS) | f.astype(np.int64))

    if len(data) > 2:
        w = data.astype(np.uint64)
        tri = w[:-2] | w[1:-1] << np.uint64(8) | w[2:] << np.uint64(16)
        row = np.repeat(np.arange(n), np.diff(offs))
        inside = row[:-2] == row[2:]
        add(tri[inside], row[:-2][inside], 1 << 40)
    starts, ends = spans(data, offs)
    if len(starts):
        row = np.searchsorted(offs, starts, "right") - 1
        h = hashes(data, starts, ends, LOWER)
        new = np.ones(len(h), bool)
        new[1:] = row[1:] != row[:-1]
        s = mix(_shapes(data, starts, ends, h, new))
        two = ~new[1:]
        three = two[1:] & two[:-1]
        add(h, row, 2 << 40)
        add((h[:-1] * _PAIR + h[1:])[two], row[1:][two], 3 << 40)
        add(s, row, 4 << 40)
        add((s[:-1] * _PAIR + s[1:])[two], row[1:][two], 5 << 40)
        add((s[:-2] * _TRIPLE + s[1:-1] * _PAIR + s[2:])[three], row[2:][three], 6 << 40)
    keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys, np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << BITS)


def fit(rows: list[np.ndarray], y: np.ndarray, *, cost: float = 1.0, epochs: int = 12, smooth: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, shift). Indicators are scaled by the classes' log-count ratios and by
    1/sqrt(their number, LEAST at least); a hinge-loss linear model is fitted by dual coordinate descent, and a
    logistic curve of its margins gives probabilities."""
    size = 1 << BITS
    p, q = np.full(size, smooth), np.full(size, smooth)
    for r, label in zip(rows, y):
        (p if label else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    xs = [ratio[r] / np.sqrt(max(LEAST, len(r))) for r in rows]
    norms = np.array([x @ x + FREE for x in xs])
    t = np.where(y, 1.0, -1.0)
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, x = rows[i], xs[i]
            g = t[i] * (w[r] @ x + bias) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), cost)
            if (d := (new - alpha[i]) * t[i]) != 0.0:
                w[r] += d * x
                bias += FREE * d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    margins = np.array([w[r] @ x + bias for r, x in zip(rows, xs)])
    a, b = 2.0, 0.0
    goal = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    for _ in range(200):  # gradient steps on the weighted logistic loss
        e = (1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30))) - goal) / len(y)
        a, b = max(0.5, a - 20 * float(e @ margins)), b - 20 * float(e.sum())
    return w * ratio, bias, a, b


def train(docs: DataFrame, labels: DataFrame, *, text: str, key: str, label: str, sample: int, seed: int):
    """Fit on at most about ``sample`` labelled rows, drawn by a hash of their key, in one task."""
    marked = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    n = marked.count()
    part = min(1.0, sample / max(1, n))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20)))
    # the draw has about `sample` rows whatever the tables' size, so it may be broadcast
    rows = tagged(docs, text, key).join(F.broadcast(drawn), "doc_id")

    def extract(batches):
        for whole in batches:
            for b in byte_batches(whole, most=1 << 20):
                keys, bounds = features(b.column(1))
                f = (keys & ((1 << BITS) - 1)).astype("<u4")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())], names=["doc_id", "y", "f"])

    def learn(batches):
        xs, ys, ids = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
            xs += [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column(2).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(xs[i]), xs[i].tobytes()))
        y = np.array([ys[i] == 1 for i in order], bool)
        if len(set(y.tolist())) == 2:
            w, bias, a, b_ = fit([xs[i] for i in order], y)
        else:  # no labels, or of one class: the share of 1 among them for every text
            share = float((y.sum() + 1) / (len(y) + 2))
            w, bias, a, b_ = np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share)))
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary()), pa.array([bias]), pa.array([a]), pa.array([b_])], names=["w", "bias", "a", "b"])

    found = rows.mapInArrow(extract, "doc_id long, y int, f binary").repartition(1).mapInArrow(learn, "w binary, bias double, a double, b double").first()
    return np.frombuffer(found["w"], "<f4").copy(), found["bias"], found["a"], found["b"]


def quality_scores(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", folds: int = 4, held_out: int = 2, threshold: float = 0.7, sample: int = 6000, seed: int = 11) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each input row; scoring doesn't shuffle.

    Labels are read only where crc32(key as text) mod ``folds`` is not ``held_out``. ``sample``
    bounds the labelled rows of the fit; every text is scored whole. What is broadcast are the
    2**18 weights, of the same size for any input.
    Null texts count as empty and, like every text without n-grams, get the score of the bias.
    Null keys are scored too (held_out is then null). Repeated labels of a document are averaged;
    labels of neither 0 nor 1 are ignored; without usable labels every score is 0.5. Repeated rows
    give a row each. Extra columns are ignored; an empty table gives an empty result.
    """
    fold = _fold(folds, held_out)
    shared, bias, a, b = _model(docs, labels, text, key, label, folds, held_out, sample, seed)

    def score(batches):
        for whole in batches:
            for part in byte_batches(whole, most=1 << 20):
                s = _probability(part.column(1), shared.value, bias, a, b)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return tagged(docs, text, key).withColumn("held_out", fold).mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", folds: int = 4, held_out: int = 2, threshold: float = 0.7, sample: int = 6000, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``; rows of
    null keys or texts are scored like any other. Parameters as for quality_scores."""
    shared, bias, a, b = _model(docs, labels, text, key, label, folds, held_out, sample, seed)
    at = docs.columns.index(text)

    def keep(batches):
        for whole in batches:
            for part in byte_batches(whole, text, most=1 << 20):
                yield part.filter(pa.array(_probability(part.column(at), shared.value, bias, a, b) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def _fold(folds: int, held_out: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_out


def _probability(col, weights, bias, a, b):
    keys, bounds = features(col)
    sums = np.concatenate([[0.0], np.cumsum(weights.astype(np.float64)[keys & ((1 << BITS) - 1)])])
    m = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(LEAST, np.diff(bounds))) + bias
    return 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))


def _model(docs, labels, text, key, label, folds, held_out, sample, seed):
    """The fitted model; its 2**18 weights, of one size for any input, are broadcast."""
    fold = _fold(folds, held_out)
    seen = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).alias("quality")).where(~fold)
    w, bias, a, b = train(docs, seen, text=text, key=key, label="quality", sample=sample, seed=seed) if key == "doc_id" else train(docs, seen.withColumnRenamed("doc_id", key), text=text, key=key, label="quality", sample=sample, seed=seed)
    return docs.sparkSession.sparkContext.broadcast(w), bias, a, b


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
