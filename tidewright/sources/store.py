"""Index tables as Parquet: one folder a version, and a small manifest that names the current one.

A version is written whole before the manifest points to it, so readers see the
old tables or the new ones. Old versions are removed by ``drop``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = (
    "index_name string, relation string, time_column string, value_columns array<string>, uncertainty boolean, timestamps boolean, "
    "start long, step long, agg_interval double, aggregate string, entries long, rank int, rank_var int, ratio double, fixed_rows int, "
    "fill boolean, normalise boolean, direct boolean, gamma double, t0 long, auto_update boolean, steps long, models int, models_var int, boundary long, boundary_var long, "
    "observed double, fallback array<double>, version string, sequence long, dropped boolean"
)


class IndexStore:
    """Tables of all indexes below one folder (any file system that Spark writes to)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def manifests(self) -> DataFrame:
        """The newest manifest row of every index that is not dropped."""
        if not self._exists(self._path("manifest")):
            return self.spark.createDataFrame([], META)
        rows = self.spark.read.schema(META).parquet(self._path("manifest"))
        newest = rows.groupBy("index_name").agg(F.max(F.struct("sequence", *(c for c in rows.columns if c not in ("index_name", "sequence")))).alias("m"))
        return newest.select("index_name", "m.*").where("not dropped").select(*rows.columns)

    def meta(self, index: str) -> dict:
        row = self.manifests().where(F.col("index_name") == index).first()
        if row is None:
            raise ValueError(f"no index {index!r}")
        return row.asDict()

    def exists(self, index: str) -> bool:
        return not self.manifests().where(F.col("index_name") == index).isEmpty()

    def publish(self, meta: dict, tables: dict[str, DataFrame]) -> dict:
        """Write the tables of a new version and make it the current one."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(self._path(f"{meta['index_name']}/{version}/{name}"))
        return self._append(meta | {"version": version, "dropped": False})

    def _append(self, meta: dict) -> dict:
        last = 0
        if self._exists(self._path("manifest")):
            last = self.spark.read.schema(META).parquet(self._path("manifest")).agg(F.max("sequence")).first()[0] or 0
        meta = meta | {"sequence": last + 1}
        names = [part.split()[0] for part in META.split(", ")]
        self.spark.createDataFrame([tuple(meta.get(n) for n in names)], META).coalesce(1).write.mode("append").parquet(self._path("manifest"))
        return meta

    def table(self, index: str, name: str, version: str | None = None) -> DataFrame:
        version = version or self.meta(index)["version"]
        return self.spark.read.parquet(self._path(f"{index}/{version}/{name}"))

    def has_table(self, index: str, name: str) -> bool:
        return self._exists(self._path(f"{index}/{self.meta(index)['version']}/{name}"))

    def drop(self, index: str) -> None:
        """Forget an index and remove its folders."""
        if not index:
            raise ValueError("an index name is needed")
        meta = self.meta(index)
        self._append(meta | {"dropped": True})
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(index))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
