"""Operator 8: exact duplicates by deterministic naming of fixed-size blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .shared import documents, numbered, stash, tagged

#: So many of the most frequent blocks are named apart, so that their copies never meet in one task;
#: any other block has at most 1/HOT of all blocks' rows.
HOT = 1024


def _blocks(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(doc_id, sha, pos, m, block): the text's bytes in blocks of ``size``; an empty text is one empty block."""
    one = tagged(docs, text, key).select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("bytes"), F.greatest(F.lit(1), F.ceil(F.octet_length("text") / size)).cast("int").alias("m"))
    cut = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.expr("bytes").substr(i * size + 1, F.lit(size)))
    return one.select("doc_id", "sha", "m", F.posexplode(cut).alias("pos", "block")).withColumn("h", F.xxhash64("block"))


def block_identities(docs: DataFrame, *, text: str = "text", key: str = "doc_id", block_bytes: int = 4096, bucket_rows: int = 256) -> DataFrame:
    """One row (doc_id, sha, level, name) for each input row; equal (level, name) means equal texts.

    Blocks are sorted into integer names: buckets of about ``bucket_rows`` blocks are ordered apart
    and a block's name is made of its rank among the bucket's distinct blocks and the bucket's
    number. Adjacent names are then paired, and the distinct pairs named the same way, until a
    document has one name left. Names come from comparing whole blocks and pairs; hashes only deal
    rows out, so no collision can join two texts. The bytes are shuffled once, and blocks with very
    many copies not at all.
    """
    blocks = _blocks(docs, text, key, block_bytes)
    # buckets by blocks, not documents: few long texts have as many blocks as many short ones
    count = tagged(docs, text, key).agg(F.sum(F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)))).first()[0] or 0
    buckets = max(1, int(count) // bucket_rows)
    frequent = blocks.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(HOT).select("h")
    # at most HOT hashes, and so about HOT blocks: a broadcast of bounded size
    hot = blocks.join(F.broadcast(frequent), "h", "left_semi").groupBy("block").agg(F.lit(1).alias("one")).select("block", (-F.row_number().over(W.Window.orderBy("block"))).cast("long").alias("name"))
    hot = stash(hot, "hot-blocks")
    named = blocks.join(F.broadcast(hot), "block").select("doc_id", "sha", "m", "pos", "name")
    cold = blocks.join(F.broadcast(hot), "block", "left_anti").withColumn("bucket", F.pmod("h", F.lit(buckets)))
    rank = F.dense_rank().over(W.Window.partitionBy("bucket").orderBy("block"))
    cold = cold.select("doc_id", "sha", "m", "pos", (rank.cast("long") * buckets + F.col("bucket")).alias("name"))
    now = stash(named.unionByName(cold), "block-names")
    every = now.where("pos = 0").select("doc_id", "sha")
    level, found = 0, now.where("m = 1").select("doc_id", "sha", F.lit(0).alias("level"), "name")
    longest = now.agg(F.max("m")).first()[0] or 1
    while longest > 1:
        level += 1
        half = F.floor(F.col("pos") / 2).cast("int")
        side = [F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(0).cast("long")) for k in (0, 1)]
        pairs = stash(now.where("m > 1").groupBy("doc_id", "sha", half.alias("pos"), F.ceil(F.col("m") / 2).cast("int").alias("m")).agg(side[0].alias("a"), side[1].alias("b")), "pairs")
        rank = F.dense_rank().over(W.Window.partitionBy("bucket").orderBy("a", "b"))
        names = pairs.select("a", "b").distinct().withColumn("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)))
        names = stash(names.select("a", "b", (rank.cast("long") * buckets + F.col("bucket")).alias("name")), "pair-names")
        now = stash(pairs.join(names, ["a", "b"]).select("doc_id", "sha", "m", "pos", "name"), "block-names")
        found = found.unionByName(now.where("m = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name"))
        longest = -(-longest // 2)
    found = found.distinct().withColumnsRenamed({"doc_id": "d", "sha": "s"})
    return every.join(found, every.doc_id.eqNullSafe(found.d) & (every.sha == found.s)).select("doc_id", "sha", "level", "name")


def exact_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", block_bytes: int = 4096) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each input row.

    Of equal texts the row with the largest key stays. Null texts count as empty, so they equal
    empty ones. Repeated rows count in group_size and, with the key that stays, are all kept. A
    null key never wins against another one; alone, its keep_id is null and it is kept.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = stash(block_identities(docs, text=text, key=key, block_bytes=block_bytes), "identities")
    groups = stash(rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", block_bytes: int = 4096) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which no other row has the same text: of
    equal texts the row of the largest key stays, of several such the last one.

    Rows go, not keys: other rows of a dropped row's key stay. A null key loses against any other;
    null texts count as empty. An empty table gives an empty result.
    """
    rows, row = numbered(docs)
    names = block_identities(rows, text=text, key=row, block_bytes=block_bytes).select(F.col("doc_id").alias(row), "level", "name")
    keys = rows.select(row, F.col(f"`{key}`").alias("key"))
    named = stash(names.join(keys, row), "named-rows")
    best = named.groupBy("level", "name").agg(F.count("*").alias("n"), F.max(F.struct("key", row)).alias("best")).where("n > 1")
    best = stash(best, "best-rows")  # a join of two tables, whose large partitions Spark can split
    gone = stash(named.join(best, ["level", "name"]).where(F.col(row) != F.col(f"best.{row}")).select(row), "dropped-rows")
    return rows.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
