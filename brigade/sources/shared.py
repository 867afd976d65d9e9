"""Tables kept for the length of a run in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only in local mode is one made if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='brigade-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read again: what is made from it doesn't make it anew."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def each_text(rows: DataFrame, text: str, made: dict[str, Column]) -> DataFrame:
    """``rows`` with columns made of their ``text`` alone: a text is worked on once, however many rows hold it,
    and joined with them; rows without a text have nulls."""
    texts = rows.select(text).where(F.col(text).isNotNull()).distinct()
    return rows.join(stash(texts.withColumns(made), "texts"), text, "left")
