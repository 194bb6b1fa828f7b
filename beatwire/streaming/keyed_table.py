"""A table of one row per key, merged in place of a copy: only changed buckets are written.

Rows lie in buckets by the hash of their key. A version is a manifest that names
the folder of every bucket. A batch reads the buckets that its keys fall into,
writes these anew into folders of its own, and then its manifest, which takes the
other buckets over as they are. Readers use the newest manifest that is complete
and never see half a batch. A batch that is run again starts from the manifest
before it; folders that no kept manifest names are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwire.operators.merge import dedupe_keep_newest
from beatwire.session import remove, written

BUCKETS = 64
KEPT_VERSIONS = 2
MANIFEST = "bucket int, n_buckets int, path string"
BUCKET = "_bucket"


class KeyedTable:
    """The table below ``path``.

    ``order`` settles which of several new rows of a key wins (nulls last, then
    all other columns); a row of a later batch always does. ``arrived`` is the
    version a row came with.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "url",
                 order: Sequence[str] = ("ord",), buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.order, self.buckets = tuple(order), buckets

    def _files(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/_manifests")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, hadoop, path

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        fs, hadoop, path = self._files()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in names if n[1:].isdigit()
                      and fs.exists(hadoop.Path(path, f"{n}/_SUCCESS")))

    def manifest(self, version: int) -> dict[int, str]:
        """Folder of every bucket that holds rows; as many entries as buckets at most."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/_manifests/v{version}").collect()
        if rows:
            self.buckets = rows[0].n_buckets  # the table's own number, whatever was asked for
        return {r.bucket: r.path for r in rows if r.path}

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest complete version, or an older one that is still kept."""
        known = self.versions()
        if version is None and not known:
            return None
        paths = self.manifest(known[-1] if version is None else version)
        return self._load(paths.values())

    def _load(self, paths) -> DataFrame | None:
        """Rows of some folders; batches may differ in columns."""
        paths = sorted(paths)
        if not paths:
            return None
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def near(self, batch: DataFrame, before: int) -> DataFrame | None:
        """Rows of the buckets that a batch's keys fall into, as of the version before one."""
        earlier = [v for v in self.versions() if v < before]
        old = self.manifest(earlier[-1]) if earlier else {}
        touched = batch.select(self.bucket_of(F.col(self.key))).distinct().collect()
        return self._load([old[r[0]] for r in touched if r[0] in old])

    def merge(self, batch: DataFrame, version: int | None = None,
              keep: Column | None = None) -> list[int]:
        """Put a batch in; the buckets that were written.

        Of the rows that were there, those that are not ``keep`` leave with the
        next batch that touches their bucket.
        """
        known = self.versions()
        version = version if version is not None else 1 + max(known, default=-1)
        earlier = [v for v in known if v < version]
        old = self.manifest(earlier[-1]) if earlier else {}
        new = written(dedupe_keep_newest(
            batch.withColumns({"arrived": F.lit(version).cast("long"), "batch_rank": F.lit(0)}),
            self.key, self.order), "batch")
        new = new.withColumn(BUCKET, self.bucket_of(F.col(self.key)))
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # bounded by the buckets
        before = self._load([old[b] for b in touched if b in old])
        rows = new
        if before is not None:
            kept = (before.withColumn(BUCKET, self.bucket_of(F.col(self.key)))
                    .join(new.select(F.col(self.key).alias("_key"), F.col(BUCKET).alias("_at")),
                          F.col(self.key).eqNullSafe(F.col("_key")) & (F.col(BUCKET) == F.col("_at")),
                          "left_anti"))
            kept = kept if keep is None else kept.where(keep)
            rows = new.unionByName(kept, allowMissingColumns=True)
        self._commit(version, {**old, **self._write(rows.drop("batch_rank"), version)})
        return sorted(touched)

    def rebucket(self, buckets: int) -> int:
        """Write all rows into another number of buckets, as a version of its own."""
        known = self.versions()
        rows = self.read()
        self.buckets = buckets
        version = known[-1] + 1
        self._commit(version, self._write(
            rows.withColumn(BUCKET, self.bucket_of(F.col(self.key))), version))
        return version

    def _write(self, rows: DataFrame, version: int) -> dict[int, str]:
        """Buckets into folders that no other attempt uses; one task writes a bucket."""
        folder = f"{self.path}/data/v{version}-{uuid.uuid4().hex[:8]}"
        rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
        fs, hadoop, _ = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(folder))]
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def _commit(self, version: int, paths: dict[int, str]) -> None:
        entries = [(b, self.buckets, p) for b, p in sorted(paths.items())] or [(-1, self.buckets, None)]
        (self.spark.createDataFrame(entries, MANIFEST).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/_manifests/v{version}"))
        known = self.versions()
        kept, expired = known[-KEPT_VERSIONS:], known[:-KEPT_VERSIONS]
        used = set().union(*[self.manifest(v).values() for v in kept])
        for v in expired:
            for path in set(self.manifest(v).values()) - used:
                remove(self.spark, path)
            remove(self.spark, f"{self.path}/_manifests/v{v}")
        self.manifest(version)  # the number of buckets is the newest version's
