"""A table of keyed rows in files that batches change in one step: buckets in versions, named by numbered manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches that a manifest remembers, so that one that is tried again changes nothing.
REMEMBERED = 1000


class Conflict(RuntimeError):
    """Another writer has made the next manifest first; the batch can be tried again."""


class Versions:
    """Rows of one key each under ``folder``, in ``buckets`` parts by the hash of the key.

    A batch writes new files of the buckets that it touches and then one manifest, which says where each bucket lies.
    Files are not changed, and readers see either manifest. The manifest's name is its number, and creating it fails
    if it is there, so that of two writers one wins. ``schema`` is that of the rows; ``keys`` are its key columns.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 16):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder, schema, keys, buckets
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """(number, content) of the newest manifest; number 0 if there is none."""
        top = self._path("manifests")
        if not self._fs.exists(top):
            return 0, {"buckets": {}, "batches": []}
        numbers = [int(f.getPath().getName()) for f in self._fs.listStatus(top) if f.getPath().getName().isdigit()]
        if not numbers:
            return 0, {"buckets": {}, "batches": []}
        text = self.spark.read.text(f"{self.folder}/manifests/{max(numbers):012d}").first()[0]
        return max(numbers), json.loads(text)

    def _commit(self, number: int, content: dict) -> None:
        """Create manifest ``number``: the content goes to a file of another name first, and is there whole or not at all."""
        draft, final = self._path(f"manifests/_draft-{uuid.uuid4().hex}"), self._path(f"manifests/{number:012d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"manifest {number} of {self.folder} exists")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, dirs: list[str]) -> DataFrame:
        if not dirs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{d}" for d in sorted(dirs)])

    def read(self) -> DataFrame:
        return self._rows(list(self._manifest()[1]["buckets"].values()))

    def upsert(self, batch: DataFrame, name: str, newer: str, insert_only: bool = False) -> bool:
        """Apply a batch: of the rows of a key, there or in the batch, the one with the largest ``newer`` stays; ties go to
        the batch, and among its own rows to the largest row. With ``insert_only`` rows that are there stay as they are.

        Returns False, and does nothing, for a batch that has been applied. Rows with a null key are left out.
        """
        number, manifest = self._manifest()
        if name in manifest["batches"]:
            return False
        columns = self._rows([]).columns
        new = batch.select(*columns).dropna(subset=self.keys).withColumn("bucket", self._bucket())
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        old = self._rows([d for b, d in manifest["buckets"].items() if int(b) in touched]).withColumn("bucket", self._bucket())
        row = F.struct(*columns)
        rank = F.struct(F.lit(int(insert_only)).alias("side"), F.col(newer), F.lit(0).alias("late"), row), F.struct(F.lit(0).alias("side"), F.col(newer), F.lit(1).alias("late"), row)
        both = old.withColumn("rank", rank[0]).unionByName(new.withColumn("rank", rank[1]))
        best = both.groupBy("bucket", *self.keys).agg(F.max_by(row, "rank").alias("row")).select("bucket", "row.*")
        version = uuid.uuid4().hex
        if touched:
            best.write.partitionBy("bucket").parquet(f"{self.folder}/data/{version}")
        moved = {str(b): f"{version}/bucket={b}" for b in touched}
        self._commit(number + 1, {"buckets": manifest["buckets"] | moved, "batches": [*manifest["batches"], name][-REMEMBERED:]})
        return True
