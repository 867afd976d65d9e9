"""From raw documents to packed sequences: the stages, each an operator of brigade.llm.

Every stage takes (spark, docs, sf_dir) and returns what its successor reads; all but the last
return the columns of ``documents``. run() writes each stage's rows as Parquet to the shared folder
and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brigade.llm.exact_dedup import drop_copies
from brigade.llm.ngram_join import drop_near_copies
from brigade.llm.packing import pack
from brigade.llm.pii import pseudonymise, secret
from brigade.llm.quality import keep_good
from brigade.llm.shared import discard, documents, folders, stash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null texts are scored as empty ones; texts without n-grams have the score of the bias, very long
    texts are scored whole. Rows of null or repeated keys are scored one by one, repeated rows alike,
    so all or none of them stay. Extra columns, whatever their names, pass unchanged. An empty table
    gives an empty one; without labels every score is 0.5 and every document goes.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal whole texts one row stays, that of the largest id.

    Rows go, not ids: another text of a dropped row's id stays. Of rows equal in text and id the last
    stays, a null id loses against any other. Null texts equal empty ones. Extra columns pass
    unchanged. An empty table gives an empty one.
    """
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle similarities of 0.8 or more the row of the smallest
    id stays.

    Rows go, not ids; a null id comes after all others, and of rows of one id the first stays. Null
    and empty texts, and those without words, are linked to nothing and stay; texts of fewer than
    five words are one shingle. Extra columns pass unchanged. An empty table gives an empty one.
    """
    return drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format, under the session's key
    (``spark.brigade.pii.secret``).

    Null texts stay null and empty ones empty; texts of any length are read whole; repeated rows get
    the same pseudonyms. Other columns, n_chars too, pass unchanged. An empty table gives an empty one.
    """
    return pseudonymise(docs, key=secret(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens.

    Null and empty texts hold the end id alone. Long texts are cut; rows of null or repeated ids are
    documents of their own. Extra columns are left out. An empty table gives an empty result.
    """
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("private", private), ("packed", packed)]

#: SQL has no classifier, Feistel network or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has read or kept aside is deleted when its own rows are
    written, so the shared folder holds the working data of one stage at a time."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with folders() as made:
            docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, before + made[:-1])  # the last one is the stage's own
        before = made[-1:]
    return docs
