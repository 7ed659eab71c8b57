"""Ledgers of keyed rows in hash buckets with generations.

A batch reads the buckets of its own keys and writes them anew, as a generation of its own; the others stay as they are.
A manifest per batch says which generation of each bucket counts (one row a bucket). A batch that runs again after a lost
executor or driver starts from the manifest before it and replaces its own generation, so nothing is counted twice. What
neither the newest manifest nor the one before names is deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "__bucket"


class BucketLedger:
    """``keys`` decide the bucket, ``schema`` names the columns (keys included). ``buckets`` is for the ledger's life: a
    batch of few keys reads about that share of the ledger, so choose it by the size that the ledger shall reach."""

    def __init__(self, path: str, keys: Sequence[str], schema: str, buckets: int = 64) -> None:
        self.path, self.keys, self.schema, self.buckets = path, list(keys), schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of these rows' keys: never more than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of some buckets (all without a choice), as left by the batches before one (by all of them)."""
        named = self._manifest(spark, before)
        wanted = [b for b in named if buckets is None or b in set(buckets)]
        if not wanted:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*[f"{self.path}/gen={named[b]}/{_BUCKET}={b}" for b in sorted(wanted)])

    def write(self, rows: DataFrame, buckets: Sequence[int], batch_id: int) -> None:
        """All rows that the touched buckets hold from now on. ``rows`` may read them as they were."""
        spark = rows.sparkSession
        before = self._manifest(spark, batch_id)
        named = {b: g for b, g in before.items() if b not in set(buckets)}
        if buckets:
            placed = rows.withColumn(_BUCKET, self.bucket())
            folder = f"{self.path}/gen={batch_id}"
            placed.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)
            # A bucket that is empty now has no folder.
            named |= {int(f.split("=")[1]): batch_id for f in self._folders(spark, folder) if f.startswith(f"{_BUCKET}=")}
        state = spark.createDataFrame([(b, g) for b, g in sorted(named.items())], "bucket int, gen long")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")
        self._prune(spark, batch_id, before, named)

    def _files(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place

    def _folders(self, spark: SparkSession, path: str) -> list[str]:
        store, place = self._files(spark, path)
        return [f.getPath().getName() for f in store.listStatus(place)] if store.exists(place) else []

    def _manifest(self, spark: SparkSession, before: int | None) -> dict[int, int]:
        batches = [int(f.split("=")[1]) for f in self._folders(spark, f"{self.path}/manifest")]
        batches = [b for b in batches if before is None or b < before]
        if not batches:
            return {}
        rows = spark.read.schema("bucket int, gen long").parquet(f"{self.path}/manifest/batch={max(batches)}")
        return {r["bucket"]: r["gen"] for r in rows.collect()}

    def _prune(self, spark: SparkSession, batch_id: int, before: dict[int, int], now: dict[int, int]) -> None:
        """Old folders of the buckets that the batch before replaced, and manifests that no batch starts from."""
        older = sorted(int(f.split("=")[1]) for f in self._folders(spark, f"{self.path}/manifest"))
        older = [b for b in older if b < batch_id]
        for batch in older[:-1]:
            gone = spark.read.schema("bucket int, gen long").parquet(f"{self.path}/manifest/batch={batch}").collect()
            for r in gone:
                if r["gen"] not in (before.get(r["bucket"]), now.get(r["bucket"])):
                    self._delete(spark, f"{self.path}/gen={r['gen']}/{_BUCKET}={r['bucket']}")
            self._delete(spark, f"{self.path}/manifest/batch={batch}")

    def _delete(self, spark: SparkSession, path: str) -> None:
        store, place = self._files(spark, path)
        store.delete(place, True)
