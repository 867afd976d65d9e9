"""What a worker of the Kneser-Ney scores holds for a batch of text."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from brigade.llm import kneser_ney


class Captured(Exception):
    pass


class Rows:
    """Stands for a table and hands out what it's to be mapped with."""

    sparkSession = None
    where = select = withColumn = agg = lambda self, *_: self

    def first(self):
        return [1 << 28]

    def mapInArrow(self, function, _):
        raise Captured(function)


class Model:
    def find(self, kind, words, columns, *_):
        return np.zeros((columns + 1, len(words)), np.int64)


def peak(function, size):
    """(peak bytes allocated, rows) over ``size`` bytes of text."""
    r = random.Random(1)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 90000}" for _ in range(200_000)]
    texts = [" ".join(r.choices(vocabulary, k=600)) for _ in range(size // 2500)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "held_out": pa.array([False] * len(texts))})
    list(function(iter([batch.slice(0, 5)])))
    tracemalloc.start()
    n = sum(b.num_rows for b in function(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6, n, len(texts)


def test_scoring_a_batch(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "tagged", lambda *_: Rows())
    monkeypatch.setattr(kneser_ney, "train", lambda *_, **__: ("", 5, 1, b"", b"", [100, 50, *[5] * 10]))
    monkeypatch.setattr(kneser_ney, "model", lambda *_: Model())
    with pytest.raises(Captured) as got:
        kneser_ney.scores(None)
    most, n, rows = peak(got.value.args[0], 8 << 20)
    assert n == rows and most < 190, most


def test_counting_a_flush(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "shared_folder", lambda *_: "")
    with pytest.raises(Captured) as got:
        kneser_ney.train(Rows())
    most, n, _ = peak(got.value.args[0], 12 << 20)
    assert n and most < 190, most
