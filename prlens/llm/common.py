"""Shared helpers of the training-data operators.

Every operator selects the columns it needs first, so extra columns of any
name in its input are ignored; a null text counts as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prlens.session import apply_conf, checkpoint_dir
from prlens.sources.tables import table

__all__ = ["bucketed", "documents", "lower_az", "map_batches", "prepare", "stored", "table", "text_hash", "without"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in an Arrow batch: texts may be long, so fewer than Spark's 10,000.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on."""
    apply_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """(doc_id long, text string never null, *extra) of a documents table."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only (locale rules never apply)."""
    return F.translate(c, UPPER, LOWER)


def text_hash(docs: DataFrame) -> Column:
    """Hash that tells rows with the same (or no) doc_id apart."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` with all columns but without the rows whose (doc_id, text_hash)
    are in ``lost``; the names of extra columns do not matter."""
    gone = lost.select(F.col("doc_id").alias("__lost_id"), F.col("text_hash").alias("__lost_text")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__lost_id")) & (text_hash(docs) == F.col("__lost_text"))
    return docs.join(gone, same, "left_anti")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    cuts the lineage, survives lost executors, fixes every value once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """As ``stored``, in ``parts`` buckets of ``key``: grouping or joining by it
    moves no row of the table.  The catalog does not keep the table."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    catalog_name = f"llm_{name.replace('-', '_')}_{run}"
    (df.write.bucketBy(parts, key).option("compression", "zstd").option("path", f"{checkpoint_dir(spark)}/llm-{name}-{run}")
     .format("parquet").saveAsTable(catalog_name))
    out = spark.table(catalog_name)
    spark.sql(f"DROP TABLE {catalog_name}")  # an external table: its files stay
    return out


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` of a generator over record batches."""
    return df.mapInArrow(fn, schema)
