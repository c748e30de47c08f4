"""A keyed table that a streaming query keeps up to date, in whole versions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32
#: Versions that stay readable; older ones are removed.
KEPT = 3


class SnapshotTable:
    """One row per key in buckets; every batch makes a version.

    A version is a small file that names the folder of each bucket. A batch writes the
    buckets that it touches to a folder of its own, and its version file last, by a
    rename: a reader sees either all of the batch or nothing of it, and the folders it
    reads stay until ``KEPT`` newer versions are there. Untouched buckets are named
    again. A batch that runs again finds its version and changes nothing; one that died
    before its version leaves a folder that nothing names.
    """

    def __init__(self, path: str, schema: T.StructType, key: str = "unit_id", buckets: int = BUCKETS):
        self.path = path.rstrip("/")
        self.schema = schema
        self.key = key
        self.buckets = buckets

    def _files(self, spark: SparkSession, below: str = ""):
        """The file system and a path in this table's folder."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/{below}" if below else self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _names(self, spark: SparkSession, below: str) -> list[str]:
        files, path = self._files(spark, below)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def versions(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches whose version is there, in order."""
        return sorted(int(n.removesuffix(".json")) for n in self._names(spark, "versions") if n.endswith(".json") and n[0] != ".")

    def _folders(self, spark: SparkSession, version: int | None) -> dict[str, str]:
        if version is None:
            return {}
        return json.loads(spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0])

    def _read(self, spark: SparkSession, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/data/{folder}/bucket={bucket}" for bucket, folder in sorted(folders.items())]
        return spark.read.schema(self.schema).parquet(*paths).select(*self.schema.names)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def current(self, spark: SparkSession) -> DataFrame:
        """The rows of the newest version."""
        versions = self.versions(spark)
        return self._read(spark, self._folders(spark, versions[-1] if versions else None))

    def update(self, rows: DataFrame, batch_id: int) -> None:
        """Puts one row per key in the place of that key's former one. ``rows`` is read twice."""
        spark = rows.sparkSession
        versions = self.versions(spark)
        if batch_id in versions:
            rows.write.format("noop").mode("overwrite").save()  # the stream's state must take in the batch again
            return
        before = [v for v in versions if v < batch_id]
        folders = self._folders(spark, before[-1] if before else None)
        rows = rows.select(*self.schema.names)
        touched = {str(r[0]) for r in rows.select(self._bucket()).distinct().collect()}  # at most one per bucket
        if touched:
            kept = self._read(spark, {b: f for b, f in folders.items() if b in touched}).join(rows, self.key, "left_anti")
            folder = f"{batch_id}-{uuid.uuid4().hex}"
            whole = kept.select(*self.schema.names).unionByName(rows).withColumn("bucket", self._bucket())
            whole.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            folders |= dict.fromkeys(touched, folder)
        self._publish(spark, batch_id, folders)
        self._remove_old(spark, batch_id)

    def _publish(self, spark: SparkSession, batch_id: int, folders: dict[str, str]) -> None:
        files, draft = self._files(spark, f"versions/.{batch_id}-{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        _, final = self._files(spark, f"versions/{batch_id}.json")
        if not files.rename(draft, final) and not files.exists(final):
            raise OSError(f"version {batch_id} could not be put in place")

    def _remove_old(self, spark: SparkSession, batch_id: int) -> None:
        versions = self.versions(spark)
        named = {f for v in versions[-KEPT:] for f in self._folders(spark, v).values()}
        old = [f"data/{n}" for n in self._names(spark, "data") if n not in named and int(n.split("-")[0]) <= batch_id]
        for below in [*old, *[f"versions/{v}.json" for v in versions[:-KEPT]]]:
            files, path = self._files(spark, below)
            files.delete(path, True)
