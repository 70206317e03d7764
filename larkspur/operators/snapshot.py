"""Keyed tables in versions: a change rewrites the buckets it touches and is switched to by one small file.

    path/data/<change>/bucket_=<b>/...   rows of a bucket as a change left them
    path/versions/<n>.json               for each bucket the change that it was last written by

A version is there once its file is: the file is created only if no other writer has
created it, so that of two writers that began from one version one wins and the other
gets Conflict. Readers follow one version file and never see half a change.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.upsert import upsert
from larkspur.session import remove_folder


class Conflict(RuntimeError):
    """Another writer's version came first; read again and repeat the change."""


@dataclass
class Snapshot:
    """A table of rows with distinct keys at path, which any file system of Spark may hold."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    buckets: int = 16

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _read(self, n: int) -> dict[str, str] | None:
        """The buckets of a version; null if its file isn't complete, as its writer died."""
        try:
            f = self._fs().open(self._at("versions", f"{n:012d}.json"))
            text = bytes(f.readAllBytes()).decode()
            f.close()
            return json.loads(text)
        except ValueError:
            return None

    def version(self) -> tuple[int, int, dict[str, str]]:
        """(last number taken, last version, its buckets); version 0 is the empty table."""
        fs, folder = self._fs(), self._at("versions")
        taken = sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []
        for n in reversed(taken):
            if (known := self._read(n)) is not None:
                return taken[-1], n, known
        return (taken or [0])[-1], 0, {}

    def _rows(self, buckets: dict[str, str]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{change}/bucket_={b}" for b, change in sorted(buckets.items())))

    def read(self, now: Column | None = None, expires: str = "expires_at", version: int | None = None) -> DataFrame:
        """The rows of the last (or a given) version; with now, only those that don't expire by then, null meaning never."""
        buckets = self.version()[2] if version is None else self._read(version) or {}
        rows = self._rows(buckets)
        return rows if now is None else rows.where(F.col(expires).isNull() | (F.col(expires) > now))

    def _publish(self, taken: int, buckets: dict[str, str]) -> int:
        fs = self._fs()
        try:
            f = fs.create(self._at("versions", f"{taken + 1:012d}.json"), False)
        except Exception as e:
            if "exist" in str(e).lower():
                raise Conflict(f"version {taken + 1} of {self.path} is another writer's") from e
            raise
        f.write(bytearray(json.dumps(buckets).encode()))
        f.close()
        return taken + 1

    def change(self, new: DataFrame, order: list, patch: bool = False) -> int:
        """Puts new rows over those of the same keys (of several the first in order); patch: nulls leave the old value. Gives the version.

        Only the buckets of the new rows' keys are read and written again. Rows with a null key are left out, as no key finds them.
        """
        taken, _, buckets = self.version()
        named = new.select(*self.spark.createDataFrame([], self.schema).columns).dropna(subset=self.keys)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [str(r.b) for r in named.select(bucket.alias("b")).distinct().collect()]  # no more than there are buckets
        if not touched:
            return taken
        old = self._rows({b: c for b, c in buckets.items() if b in touched})
        change = uuid.uuid4().hex
        merged = upsert(old, named, self.keys, order, patch).withColumn("bucket_", bucket)
        merged.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{change}")
        try:
            return self._publish(taken, buckets | dict.fromkeys(touched, change))
        except Conflict:
            remove_folder(self.spark, f"{self.path}/data/{change}")
            raise

    def drop_expired(self, now: Column, expires: str = "expires_at") -> int:
        """Rewrites the buckets that hold expired rows without them; gives the version."""
        taken, _, buckets = self.version()
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        old = self._rows(buckets)
        touched = [str(r.b) for r in old.where(F.col(expires) <= now).select(bucket.alias("b")).distinct().collect()]
        if not touched:
            return taken
        change = uuid.uuid4().hex
        left = self._rows({b: buckets[b] for b in touched}).where(F.col(expires).isNull() | (F.col(expires) > now)).withColumn("bucket_", bucket)
        left.repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/data/{change}")
        kept = {str(r.b) for r in left.select(F.col("bucket_").alias("b")).distinct().collect()}
        return self._publish(taken, {b: change if b in touched else c for b, c in buckets.items() if b not in touched or b in kept})

    def vacuum(self, keep: int = 2) -> None:
        """Removes the data that none of the last so many versions names; readers of older versions must be done."""
        taken, _, _ = self.version()
        used = {c for n in range(max(1, taken - keep + 1), taken + 1) for c in (self._read(n) or {}).values()}
        fs = self._fs()
        for s in fs.listStatus(self._at("data")):
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
