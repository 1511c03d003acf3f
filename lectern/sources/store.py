"""Keyed result store on Parquet: read, upsert, clear, evict.

Each write goes to a folder of its own and then claims the next version number by renaming a one-line file to it, which
fails if another writer has it already. The loser reads the newer version and tries again, so no update is lost; a reader never
sees a half-written table and a lost executor only repeats tasks.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern import values as v


def latest_per_key(rows: DataFrame, key: str = "cache_key", order: str = "created_at") -> DataFrame:
    """Newest row per key; a grouped maximum combines before the shuffle, a window would not. Ties go by the rows' hash."""
    total = F.struct(order, F.xxhash64(*rows.columns))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), total).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "cache_key") -> DataFrame:
    """``new`` replaces whole rows of ``old`` by key."""
    tagged = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    ranked = tagged.withColumn("_rank", F.struct("_age", "created_at"))
    return latest_per_key(ranked, key, "_rank").drop("_age", "_rank")


def evict(rows: DataFrame, capacity: int = v.STORE_CAPACITY) -> DataFrame:
    """The newest ``capacity`` entries. The limit is the feature; each task keeps only its own top entries."""
    return rows.orderBy(F.col("created_at").desc(), F.col("cache_key").desc()).limit(capacity)


class ResultStore:
    """``keep`` versions stay on disk, so that a table that was read just before a write can still be used."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        place = self._hadoop.Path(self.path)
        self._fs = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Numbers of the versions on disk, ascending."""
        place = self._hadoop.Path(f"{self.path}/versions")
        if not self._fs.exists(place):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(place)]
        return sorted(int(name) for name in names if name.isdigit())

    def _folder(self, version: int) -> str:
        return self.spark.read.text(f"{self.path}/versions/{version:020d}").first()[0]

    def _claim(self, version: int, folder: str) -> bool:
        """Names ``folder`` as the version's data, unless another writer has claimed the number."""
        aside = self._hadoop.Path(f"{self.path}/aside/{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(folder.encode()))
        stream.close()
        target = self._hadoop.Path(f"{self.path}/versions/{version:020d}")
        self._fs.mkdirs(target.getParent())
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(aside, target, self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0))
            return True
        except Py4JJavaError as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise

    def _commit(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replaces the rows by ``change`` of them, of whichever version is the newest when it succeeds; its number."""
        while True:
            versions = self._versions()
            newest = versions[-1] if versions else 0
            folder = f"{self.path}/data-{uuid.uuid4().hex}"
            change(self._read(newest)).write.parquet(folder)
            if self._claim(newest + 1, folder):
                self._forget(versions[:len(versions) + 1 - self.keep])
                return newest + 1
            self._fs.delete(self._hadoop.Path(folder), True)

    def _forget(self, versions: list[int]) -> None:
        for version in versions:
            self._fs.delete(self._hadoop.Path(self._folder(version)), True)
            self._fs.delete(self._hadoop.Path(f"{self.path}/versions/{version:020d}"), False)

    def _read(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(version))

    def read(self) -> DataFrame:
        return self._read((self._versions() or [0])[-1])

    def upsert(self, new: DataFrame, capacity: int | None = None) -> int:
        """``new`` replaces rows by key; beyond ``capacity`` the oldest go. Returns the version's number."""
        def change(old: DataFrame) -> DataFrame:
            rows = upsert(old, new)
            return rows if capacity is None else evict(rows, capacity)

        return self._commit(change)

    def clear(self) -> int:
        """Empty the store; returns how many entries it held."""
        held = 0

        def change(rows: DataFrame) -> DataFrame:
            nonlocal held
            held = rows.count()
            return rows.where("false")

        self._commit(change)
        return held
