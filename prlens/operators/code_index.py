"""The code index at rest: buckets that are written anew only when touched.

    <base>/data/v=<n>/bucket=<b>/   the entries of bucket b as of version n
    <base>/manifest/v=<n>/          version n: which data version is live for each bucket

An entry lives in the bucket of its id's hash.  A change writes the buckets of the
changed entries to a new data version and then moves a new manifest into place, in one
rename; nothing live is ever written over, so a reader keeps the version it opened
and sees all of a change or nothing.  One writer at a time: a second one that would
make the same version fails and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prlens.operators.retrieval import index_rows, index_upsert
from prlens.session import written

BUCKETS = 256


class CodeIndex:
    """An index in folder ``base`` (any URI of a shared file system) with a fixed number of buckets."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest version; 0 for an index that holds nothing yet."""
        fs, p = self._path(f"{self.base}/manifest")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(n[2:]) for n in names if n.startswith("v=")), default=0)

    def live(self, version: int | None = None) -> dict[int, int]:
        """Bucket -> data version (a row for each bucket at most)."""
        version = self.version() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.schema("bucket int, live long").json(f"{self.base}/manifest/v={version}").collect()
        return {r["bucket"]: r["live"] for r in rows}

    def _read(self, live: dict[int, int], schema) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/data/v={v}/bucket={b}" for b, v in sorted(live.items())])

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        """All entries of a version, the newest by default."""
        live = self.live(version)
        if not live and schema is None:
            raise ValueError("the index is empty: give its schema")
        if schema is None:
            b, v = next(iter(live.items()))
            schema = self.spark.read.parquet(f"{self.base}/data/v={v}/bucket={b}").schema
        return self._read(live, schema)

    def upsert(self, files: DataFrame) -> int:
        """Entries for ``files`` replace those of their ids; returns the version that holds them.

        Entries that are there already, just as they are, change nothing: a replayed
        upsert writes nothing and keeps the version."""
        new = index_rows(files)
        # Of several new rows of an id, the one that index_upsert defines.
        new = written(index_upsert(new.limit(0), files).withColumn("bucket", self._bucket()), "upsert")
        schema = new.drop("bucket").schema
        version = self.version()
        live = self.live(version)
        asked = {r[0] for r in new.select("bucket").distinct().collect()}
        old = self._read({b: v for b, v in live.items() if b in asked}, schema)
        same = [new[c].eqNullSafe(old[c]) for c in schema.names]
        cond = same[0]
        for x in same[1:]:
            cond = cond & x
        changed = written(new.join(old, cond, "left_anti"), "upsert")
        touched = {r[0] for r in changed.select("bucket").distinct().collect()}
        if not touched:
            return version
        kept = self._read({b: v for b, v in live.items() if b in touched}, schema).join(
            changed.select("id"), "id", "left_anti").withColumn("bucket", self._bucket())
        return self._publish(version, live, touched, kept.unionByName(changed))

    def clear(self, repo: str) -> int:
        """Drop every entry of a repo; only the buckets that hold one are written anew."""
        version = self.version()
        live = self.live(version)
        if not live:
            return version
        rows = self.read(version).withColumn("bucket", self._bucket())
        touched = {r[0] for r in rows.filter(F.col("repo_name").eqNullSafe(repo)).select("bucket").distinct().collect()}
        if not touched:
            return version
        kept = self._read({b: live[b] for b in touched}, rows.drop("bucket").schema).filter(
            ~F.col("repo_name").eqNullSafe(repo)).withColumn("bucket", self._bucket())
        return self._publish(version, live, touched, kept)

    def _publish(self, version: int, live: dict[int, int], touched: set[int], rows: DataFrame) -> int:
        new = version + 1
        data = f"{self.base}/data/v={new}"
        # What a writer that died before its manifest left behind is nobody's.
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        fs, folder = self._path(data)
        made = {s.getPath().getName() for s in fs.listStatus(folder)}
        live = {b: v for b, v in live.items() if b not in touched} | {b: new for b in touched if f"bucket={b}" in made}
        draft = f"{self.base}/drafts/{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(live.items()), "bucket int, live long").coalesce(1).write.json(draft)
        target = f"{self.base}/manifest/v={new}"
        fs, at = self._path(target)
        fs.mkdirs(at.getParent())
        if fs.exists(at) or not fs.rename(self._path(draft)[1], at):
            raise RuntimeError(f"version {new} of the index was published by another writer")
        return new
