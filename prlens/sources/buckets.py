"""Tables at rest in a fixed number of key buckets, one folder each.

A stream's micro-batch asks for the few keys it holds; with the buckets of these
keys as a literal partition filter, only their folders are listed and read, so a
batch's bytes follow the batch and not the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from prlens.session import written

#: Folders of a table.  More of them make a small batch read less; each is at least one file.
BUCKETS = 64
BUCKET = "key_bucket"


def bucket_of(keys: Sequence[str], buckets: int = BUCKETS) -> Column:
    """Bucket of a row's key; a null in the key is a value like any other."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write ``df`` bucketed by ``keys``.  The rebalance deals a bucket with a hot
    key over several tasks and files."""
    rows = df.withColumn(BUCKET, bucket_of(keys, buckets)).hint("rebalance", BUCKET)
    rows.write.partitionBy(BUCKET).mode("overwrite").parquet(path)


def wanted_buckets(only: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> list[int]:
    """Buckets of the keys in ``only``: at most ``buckets`` numbers reach the driver."""
    return sorted(r[0] for r in only.select(bucket_of(keys, buckets).alias("b")).distinct().collect())


def read_buckets(spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], only: DataFrame | None = None,
                 wanted: list[int] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a bucketed table (``schema``: its columns), whole or those whose key is in
    ``only``.  No key gives no row, and a key that is null matches nothing.  ``wanted``: the
    keys' buckets, where they are known."""
    table = spark.read.schema(StructType([*schema.fields, StructField(BUCKET, IntegerType())])).parquet(path)
    if only is None:
        return table.drop(BUCKET)
    wanted = wanted_buckets(only, keys, buckets) if wanted is None else wanted
    return (table.filter(F.col(BUCKET).isin(wanted)).drop(BUCKET)
            .join(only.select(*keys).distinct(), list(keys), "left_semi").select(*schema.names))


class PrStore:
    """Domain tables of pull requests, bucketed by (repo, PR), and commits by (repo, path)."""

    KEYS = ("repo_name", "pr_number")
    COMMIT_KEYS = ("repo_name", "path")

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schemas: dict = {}

    def _keys(self, name: str) -> tuple[str, ...]:
        return self.COMMIT_KEYS if name == "commit" else self.KEYS

    def put(self, name: str, df: DataFrame) -> None:
        self.schemas[name] = df.schema
        write_buckets(df, f"{self.path}/{name}", self._keys(name), self.buckets)

    def get(self, name: str, only: DataFrame | None = None, wanted: list[int] | None = None) -> DataFrame:
        return read_buckets(self.spark, f"{self.path}/{name}", self.schemas[name], self._keys(name), only, wanted,
                            self.buckets)

    def reader(self, requests: DataFrame):
        """``read(name)`` for the PRs of a batch of requests.  The batch's keys and the
        paths its PRs touch are written once, and every table is cut by them."""
        prs = written(requests.select(*self.KEYS).distinct(), "batch-prs")
        at = wanted_buckets(prs, self.KEYS, self.buckets)
        files = written(self.get("file", prs, at), "batch-files")
        paths = files.select("repo_name", F.col("filename").alias("path")).distinct()

        def read(name: str) -> DataFrame:
            if name == "file":
                return files
            return self.get(name, paths) if name == "commit" else self.get(name, prs, at)

        return read
