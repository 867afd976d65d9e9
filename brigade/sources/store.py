"""A keyed table in versions: readers see one whole version, writers commit the next one or start again."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def last_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key's rows the last by ``order``. Where rows have a _bucket they are dealt by it, no two to a task that
    others could take, and grouped there."""
    by = [c for c in ("_bucket", key) if c in rows.columns]
    if "_bucket" in by:
        top = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
        rows = rows.repartitionById(int(top), F.col("_bucket"))
    values = [c for c in rows.columns if c not in by]
    kept = rows.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return kept.select(*by, *[F.col(f"v.{c}").alias(c) for c in values])


class Store:
    """Rows by ``key`` at ``path``, in buckets by the keys' hashes.

    ``path/versions`` has a file for each version that names the folder of every bucket; data folders
    are never written twice. A writer writes the buckets that it touches anew, each as a whole, and then
    creates the next version's file, which only one of several writers can. Another one takes up what
    was committed meanwhile and tries again, computing only the buckets that both have touched. What a
    killed writer leaves is in no version.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def version(self) -> tuple[int, dict]:
        """The newest version's number and manifest; 0 where there's none yet."""
        folder = self._at(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0, {"buckets": self.buckets, "folders": {}, "applied": {}}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        newest = max((int(n) for n in names if n.isdigit()), default=0)
        return (newest, self._manifest(newest)) if newest else (0, {"buckets": self.buckets, "folders": {}, "applied": {}})

    def _manifest(self, number: int) -> dict:
        stream = self._fs.open(self._at(self._name(number)))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _name(self, number: int) -> str:
        return f"{self.path}/versions/{number:020d}"

    def _commit(self, number: int, manifest: dict) -> bool:
        """Create a version's file; False where another writer has."""
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        out = self._fs.create(self._at(draft), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(self._at(f"{self.path}/versions"))
        if self._local:  # a link to a name that exists fails, a renaming doesn't
            plain = lambda p: self._at(p).toUri().getPath()
            try:
                os.link(plain(draft), plain(self._name(number)))
            except FileExistsError:
                return False
            finally:
                self._fs.delete(self._at(draft), False)
            return True
        if not self._fs.rename(self._at(draft), self._at(self._name(number))):
            self._fs.delete(self._at(draft), False)
            return False
        return True

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in sorted(manifest["folders"].items()) if buckets is None or int(b) in buckets]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def frame(self) -> DataFrame:
        """The rows of the newest version. A writer that commits later changes nothing in it."""
        return self._read(self.version()[1])

    def touched(self, rows: DataFrame, key: str, buckets: int) -> list[int]:
        return [r[0] for r in rows.where(F.col(key).isNotNull()).select(self.bucket(F.col(key), buckets)).distinct().collect()]  # at most `buckets`

    def lookup(self, keys: DataFrame, key: str | None = None) -> DataFrame:
        """The rows of the buckets that hold any of the keys: no other bucket's files are in the plan."""
        manifest = self.version()[1]
        return self._read(manifest, self.touched(keys, key or self.key, manifest["buckets"]))

    def changes(self, since: int) -> tuple[DataFrame, int]:
        """(rows of the newest version that version ``since`` didn't have so, the newest version's number).
        Only buckets that were written since are read; every row counts as changed where ``since`` is 0
        or was vacuumed."""
        number, new = self.version()
        if not since or since > number or not self._fs.exists(self._at(self._name(since))):
            return self._read(new), number
        old = self._manifest(since)
        fresh = [int(b) for b, f in new["folders"].items() if old["folders"].get(b) != f]
        rows = self._read(new, fresh)
        print_ = F.xxhash64(*[F.col(c) for c in rows.columns])
        before = self._read(old, fresh).select(F.col(self.key).alias("_key"), print_.alias("_print"))
        return rows.join(before, (F.col(self.key) == F.col("_key")) & (print_ == F.col("_print")), "left_anti"), number

    def upsert(self, writes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], *, by_bucket: bool = False, stream: str = "", batch: int = -1, tries: int = 50) -> int:
        """Commit ``merge(old rows, writes)`` of every bucket that the writes touch; returns the version.

        ``merge`` must treat keys apart. With ``by_bucket`` it is given rows with a column _bucket, and returns such
        rows dealt by it (``last_of``): they are shuffled once, for merging and writing. A batch of a stream that was committed before isn't again.
        """
        writes = writes.where(F.col(self.key).isNotNull())
        done: dict[int, str] = {}
        made: dict[int, str | None] = {}  # what each bucket was when it was merged
        for _ in range(tries):
            number, manifest = self.version()
            if stream and manifest["applied"].get(stream, -1) >= batch:
                return number
            n = manifest["buckets"]
            touched = self.touched(writes, self.key, n)
            stale = [b for b in touched if b not in done or made[b] != manifest["folders"].get(str(b))]
            if stale:
                folder = f"data/{uuid.uuid4().hex}"
                named = lambda df: df.withColumn("_bucket", self.bucket(F.col(self.key), n))
                mine = writes.where(self.bucket(F.col(self.key), n).isin(stale))
                if by_bucket:
                    rows = merge(named(self._read(manifest, stale)), named(mine))
                else:
                    rows = named(merge(self._read(manifest, stale), mine)).repartition("_bucket")
                rows.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                for b in stale:
                    done[b], made[b] = f"{folder}/_bucket={b}", manifest["folders"].get(str(b))
            if not touched and not stream:
                return number
            folders = manifest["folders"] | {str(b): f for b, f in done.items() if b in touched}
            applied = manifest["applied"] | ({stream: batch} if stream else {})
            if self._commit(number + 1, {"buckets": n, "folders": folders, "applied": applied}):
                return number + 1
        raise RuntimeError(f"{self.path}: another writer was faster {tries} times")

    def applied(self, stream: str) -> int:
        """The last batch of a stream that a version holds; -1 if none."""
        return self.version()[1]["applied"].get(stream, -1)

    def vacuum(self, keep: int = 10) -> int:
        """Delete versions but the last ``keep``, and data folders that none of those names and that are older
        than the oldest of them (a writer that is at work has younger ones); returns how many folders."""
        newest, _ = self.version()
        kept = [n for n in range(max(1, newest - keep + 1), newest + 1)]
        if not kept or not self._fs.exists(self._at(f"{self.path}/data")):
            return 0
        named = {f.split("/")[1] for n in kept for f in self._manifest(n)["folders"].values()}
        since = self._fs.getFileStatus(self._at(self._name(kept[0]))).getModificationTime()
        gone = 0
        for n in range(kept[0] - 1, 0, -1):
            if not self._fs.delete(self._at(self._name(n)), False):
                break  # those before went earlier
        for s in self._fs.listStatus(self._at(f"{self.path}/data")):
            if s.getPath().getName() not in named and s.getModificationTime() < since:
                gone += bool(self._fs.delete(s.getPath(), True))
        return gone
