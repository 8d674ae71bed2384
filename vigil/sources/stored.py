"""A table by key that runs continue: hash buckets, versions, one manifest per commit.

``{path}/data/{name}/bucket=7`` holds rows, ``{path}/manifest/version=3`` one row: which folder each bucket is in, and the names of the runs that
made it. A run reads the buckets that its rows fall into, merges, writes these buckets to a new folder and then the manifest. Only the
manifest makes them count: a run that dies before leaves folders that nobody reads, and one that is repeated after it changes nothing. Two
writers of one version collide on its folder; the second one fails and may be run again. Readers keep the version that they began with.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.streaming.storage import written

_MANIFEST = "folders map<int,string>, runs array<string>, buckets int"


class KeyedTable:
    """Rows of ``schema`` with one row per ``keys``. ``buckets`` holds for the life of the table: choose it so that a bucket is a task's worth
    of rows at the size the table will have."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    # ---- manifest
    def _versions(self) -> list[int]:
        """Committed versions. The listing goes through the path's own file system, wherever that is."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/manifest")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        done = [p.getName() for p in names if fs.exists(hadoop.Path(p, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith("version="))

    def _manifest(self, version: int | None = None) -> tuple[int, dict[int, str], list[str]]:
        versions = self._versions()
        if not versions:
            return 0, {}, []
        version = versions[-1] if version is None else version
        row = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}").first()
        if row.buckets != self.buckets:
            raise ValueError(f"the table has {row.buckets} buckets")
        return version, row.folders, row.runs

    @property
    def version(self) -> int:
        return self._manifest()[0]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # ---- rows
    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(sorted(self._manifest(version)[1].values()))

    def find(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys; only their buckets are read."""
        _, folders, _ = self._manifest()
        return self._rows(self._touched(keys, folders)[1]).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, rows: DataFrame, folders: dict[int, str]) -> tuple[list[int], list[str]]:
        touched = [r.b for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # as many as there are buckets
        return touched, sorted(folders[b] for b in touched if b in folders)

    def upsert(self, new: DataFrame, merge: Callable[[DataFrame], DataFrame], run: str) -> bool:
        """Merge ``new`` rows in. ``merge`` gets the stored rows of the touched buckets and the new ones in one frame and returns one row per key.
        False when ``run`` has been merged before."""
        version, folders, runs = self._manifest()
        if run in runs:
            return False
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows = written(new.select(*typed), "upsert")
        touched, old = self._touched(rows, folders)
        name = uuid.uuid4().hex
        if touched:
            merged = merge(self._rows(old).unionByName(rows)).select(*typed).withColumn("bucket", self.bucket())
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        folders = {**folders, **{b: f"{self.path}/data/{name}/bucket={b}" for b in touched}}
        manifest = self.spark.createDataFrame([(folders, [*runs, run], self.buckets)], _MANIFEST).coalesce(1)
        manifest.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version + 1}")
        return True
