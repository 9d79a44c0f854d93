"""Tables that keep their versions: a manifest names the data of each bucket, and a change rewrites only the buckets that it touches.

Layout below the table's folder, in whatever store Spark writes to: ``data/<change>/_bucket=<n>/*.parquet`` and
``versions/<number>.json``. A manifest is made by creating a file that must not be there yet, so of two changes that start from one
version the second fails and has changed nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import catalog as R


class VersionConflict(RuntimeError):
    """Another change has made the version that this one was about to make."""


class VersionedTable:
    """A table with keys, dealt to buckets by their hash; rows with null keys are in one bucket and equal no other row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.store = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self.store.listStatus(folder)] if self.store.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of, the latest by default: keys, schema, number of buckets, and the change that wrote each."""
        found = self.versions()
        version = version if version is not None else max(found, default=0)
        if version not in found:
            raise ValueError(f"{self.path} has no version {version}")
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0])

    def _commit(self, manifest: dict, note: str) -> int:
        number = manifest["version"] + 1
        target = self._path(f"{self.path}/versions/{number}.json")
        self.store.mkdirs(target.getParent())
        try:
            out = self.store.create(target, False)
        except Exception as e:
            if self.store.exists(target):
                raise VersionConflict(f"{self.path} has a version {number} already") from e
            raise
        try:
            out.write(bytearray(json.dumps(manifest | {"version": number, "note": note}).encode()))
        finally:
            out.close()
        return number

    # -- data

    def _bucketed(self, df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def _write(self, df: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """The rows in a folder of their own, one file or more for each bucket: which buckets there are now."""
        change = uuid.uuid4().hex
        target = f"{self.path}/data/{change}"
        self._bucketed(df, keys, buckets).repartition("_bucket").write.partitionBy("_bucket").parquet(target)
        names = [s.getPath().getName() for s in self.store.listStatus(self._path(target))]
        return {n.removeprefix("_bucket="): change for n in names if n.startswith("_bucket=")}

    def _read(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{change}/_bucket={b}" for b, change in sorted(manifest["buckets"].items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def create(self, df: DataFrame, keys: list[str], buckets: int = 64, note: str = "create") -> int:
        """The first version, from ``df``."""
        empty = {"version": 0, "keys": keys, "n_buckets": buckets, "schema": df.schema.jsonValue()}
        return self._commit(empty | {"buckets": self._write(df, keys, buckets)}, note)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def _change(self, rows: DataFrame, change: Callable[[DataFrame], DataFrame], note: str, base: dict | None = None) -> int:
        """A version in which ``change`` is made to the buckets that the keys of ``rows`` fall in; the other buckets' files are shared."""
        m = base or self.manifest()
        touched = {str(r[0]) for r in self._bucketed(rows.select(*m["keys"]), m["keys"], m["n_buckets"]).select("_bucket").distinct().collect()}  # n_buckets at most
        if not touched:
            return m["version"]
        kept = {b: c for b, c in m["buckets"].items() if b not in touched}
        return self._commit(m | {"buckets": kept | self._write(change(self._read(m, touched)), m["keys"], m["n_buckets"])}, note)

    def upsert(self, rows: DataFrame, base: dict | None = None) -> int:
        return self._change(rows, lambda t: R.upsert(t, rows, self.manifest()["keys"]), "upsert", base)

    def insert_ignore(self, rows: DataFrame, base: dict | None = None) -> int:
        return self._change(rows, lambda t: R.insert_ignore(t, rows, self.manifest()["keys"]), "insert", base)

    def update(self, rows: DataFrame, columns: list[str], base: dict | None = None) -> int:
        return self._change(rows, lambda t: R.update(t, rows, self.manifest()["keys"], columns), "update", base)

    def delete(self, rows: DataFrame, base: dict | None = None) -> int:
        """Without the rows whose keys are in ``rows``. The version before is the backup: ``restore`` brings it back."""
        return self._change(rows, lambda t: t.join(rows.select(*self.manifest()["keys"]), self.manifest()["keys"], "left_anti"), "delete", base)

    def restore(self, version: int) -> int:
        """A new version that is an earlier one again; no data is written."""
        return self._commit(self.manifest(version) | {"version": self.manifest()["version"]}, f"restore {version}")

    def clean(self, keep: int) -> list[str]:
        """Forget all versions but the last ``keep`` and delete the data that none of these has: the changes deleted."""
        found = self.versions()
        held = {c for v in found[-keep:] for c in self.manifest(v)["buckets"].values()} if keep > 0 else set()
        if not held and found:
            raise ValueError("at least one version has to be kept")
        for v in found[:-keep]:
            self.store.delete(self._path(f"{self.path}/versions/{v}.json"), False)
        gone = [s.getPath().getName() for s in self.store.listStatus(self._path(f"{self.path}/data")) if s.getPath().getName() not in held]
        for change in gone:
            self.store.delete(self._path(f"{self.path}/data/{change}"), True)
        return sorted(gone)


def delete_runs(tables: dict[str, VersionedTable], doomed: DataFrame) -> dict[str, tuple[int, int]]:
    """Delete the runs ``doomed(run_id)`` from versioned tables that have a run_id: (version before, version after) of each. Where a table
    fails, those before it are restored."""
    done: dict[str, tuple[int, int]] = {}
    try:
        for name, table in tables.items():
            before = table.manifest()["version"]
            rows = table.read().join(doomed.select("run_id"), "run_id", "left_semi")
            done[name] = (before, table.delete(rows))
    except Exception:
        for name, (before, after) in done.items():
            if after != before:
                tables[name].restore(before)
        raise
    return done
