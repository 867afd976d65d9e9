"""Operator 3: exact token counts of whole texts, only lengths leave the Python workers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .shared import byte_batches, documents, tagged

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, *, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, limit: int = 1024, batch_bytes: int = 4 << 20, piece_chars: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each input row, without any shuffle.

    Arrow batches are cut anew by bytes, so that one of long texts takes no more memory than one
    of short texts, and each is encoded in one call. Texts over ``piece_chars`` are encoded in pieces
    cut where no token can cross.
    Null and empty texts: 0 bytes, 0 tokens. Repeated rows and repeated or null keys: a row each.
    Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    path = tokenizer or bpe.default_path()

    def add(enc, tokens, rows, held):
        for i, n in zip(rows, enc.lengths(held)):
            tokens[i] += n
        rows.clear()
        held.clear()

    def count(batches):
        enc = bpe.encoder(path)
        for whole in batches:
            for b in byte_batches(whole, most=batch_bytes):
                texts = b.column(1).to_pylist()
                tokens, rows, held, size = [0] * len(texts), [], [], 0
                for i, t in enumerate(texts):
                    for piece in bpe.safe_pieces(t, piece_chars):
                        rows.append(i)
                        held.append(piece)
                        size += len(piece)
                        if size >= batch_bytes:  # a long text takes several batches
                            add(enc, tokens, rows, held)
                            size = 0
                add(enc, tokens, rows, held)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return tagged(docs, text, key).mapInArrow(count, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
