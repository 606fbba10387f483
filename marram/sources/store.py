"""A table in hash buckets with versions: merges rewrite the buckets they touch and nothing else.

Below its folder a store has ``data``, a folder for each write with folders by
bucket, and ``versions/v=N``, which lists the folders that make up version N and
the last batch that it holds. A version counts once its listing is complete, so
that a write that fails half-way leaves the last version as it was; two writers
can't make the same version.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators.relational import exclude, first_by

BUCKET = "__bucket"
LISTING = "bucket int, path string, batch long, buckets int, keys array<string>"


class Store:
    """The latest version of a table by ``keys``; rows with null keys are compared as values."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.held: tuple[int, DataFrame] | None = None

    @classmethod
    def create(cls, df: DataFrame, folder: str, keys: list[str], buckets: int = 64) -> Store:
        """A new store of these rows. ``buckets`` should make buckets of some hundred megabytes at the size that the table will reach."""
        store = cls(df.sparkSession, folder)
        store.publish(0, store.written(df, keys, buckets), [], -1, keys, buckets)
        return store

    def versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(re.search(r"/v=([0-9]+)/", str(x.getPath()))[1]) for x in found or [])

    def listing(self, version: int | None = None) -> tuple[int, list]:
        """The version and its rows: one for each bucket and folder that holds rows of it, and one of bucket -1 for the version itself."""
        version = self.versions()[-1] if version is None else version
        return version, self.spark.read.schema(LISTING).parquet(f"{self.folder}/versions/v={version}").collect()

    def publish(self, version: int, folders: list[tuple[int, str]], kept: list, batch: int, keys: list[str], buckets: int) -> None:
        rows = [(-1, "", batch, buckets, keys), *((b, p, batch, buckets, keys) for b, p in folders), *((r["bucket"], r["path"], batch, buckets, keys) for r in kept)]
        self.spark.createDataFrame(rows, LISTING).coalesce(1).write.mode("error").parquet(f"{self.folder}/versions/v={version}")

    def written(self, df: DataFrame, keys: list[str], buckets: int) -> list[tuple[int, str]]:
        """Write the rows by bucket; (bucket, folder) of all that got any."""
        path = f"data/{uuid.uuid4().hex}"
        rows = df.withColumn(BUCKET, self.bucket_of(keys, buckets))
        # Spark brings a bucket's rows together, and splits a bucket that is much larger than others.
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{path}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}/{BUCKET}=*")
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(where)
        return [(int(str(x.getPath()).rsplit("=", 1)[1]), f"{path}/{BUCKET}={str(x.getPath()).rsplit('=', 1)[1]}") for x in found or []]

    @staticmethod
    def bucket_of(keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, of certain buckets only if they are given; None where it has none."""
        _, rows = self.listing(version)
        paths = [f"{self.folder}/{r['path']}" for r in rows if r["bucket"] >= 0 and (buckets is None or r["bucket"] in buckets)]
        return self.spark.read.parquet(*paths) if paths else None

    def cached(self) -> DataFrame | None:
        """The latest version, kept in memory until there is a newer one."""
        version = self.versions()[-1]
        if self.held is None or self.held[0] != version:
            self.release()
            rows = self.read(version)
            self.held = None if rows is None else (version, rows.cache())
        return self.held[1] if self.held else None

    def release(self) -> None:
        if self.held is not None:
            self.held[1].unpersist()
            self.held = None

    def merge(self, changed: DataFrame, order: list[Column] | None = None, batch: int | None = None, delete: bool = False) -> int:
        """The new version, in which changed rows stand in place of those of equal keys; with ``delete`` nothing does.

        Of changed rows of equal keys the first by ``order`` is kept, all without
        an order. A batch that the store holds already changes nothing.
        """
        version, rows = self.listing()
        head = next(r for r in rows if r["bucket"] == -1)
        if batch is not None and batch <= head["batch"]:
            return version
        keys, buckets = head["keys"], head["buckets"]
        changed = first_by(changed, keys, order) if order else changed
        touched = {r["b"] for r in changed.select(self.bucket_of(keys, buckets).alias("b")).distinct().collect()}  # at most one row for each bucket
        old = self.read(version, sorted(touched))
        new = changed.limit(0) if delete else changed
        rest = exclude(old, changed, keys).unionByName(new, allowMissingColumns=True) if old is not None else new
        kept = [r for r in rows if r["bucket"] >= 0 and r["bucket"] not in touched]
        self.publish(version + 1, self.written(rest, keys, buckets), kept, head["batch"] if batch is None else batch, keys, buckets)
        return version + 1

    def append(self, added: DataFrame, batch: int | None = None) -> int:
        """The new version, with rows added to the buckets; nothing is rewritten."""
        version, rows = self.listing()
        head = next(r for r in rows if r["bucket"] == -1)
        if batch is not None and batch <= head["batch"]:
            return version
        self.publish(version + 1, self.written(added, head["keys"], head["buckets"]), [r for r in rows if r["bucket"] >= 0], head["batch"] if batch is None else batch, head["keys"], head["buckets"])
        return version + 1

    def forget_before(self, version: int) -> None:
        """Delete older versions and the folders that no later one lists."""
        later = {r["path"] for v in self.versions() if v >= version for r in self.listing(v)[1]}
        older = [v for v in self.versions() if v < version]
        gone = {r["path"] for v in older for r in self.listing(v)[1]} - later
        for path in [*gone - {""}, *(f"versions/v={v}" for v in older)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
