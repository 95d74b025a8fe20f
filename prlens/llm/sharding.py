"""Operator 4: reproducible shuffle into shards by a Feistel permutation.

Documents are numbered 0..n-1 in the order of doc_id (then text checksum, then
size; equal rows are interchangeable): a range sort of three numbers a row, a
count for each range partition, and no text in the shuffle.  A keyed Feistel
permutation with cycle walking maps row number r to p(r); shard = p mod shards,
slot = p div shards.  So counts differ by one at most (law ``rows``), slots have
no gap, the place of any row is computed from its number alone, and
``row_of`` names the row in any (shard, slot).  The law does not depend on
texts, so equal texts are dealt out like any others.

Defined results: a null text has size 16 and checksum 0; null ids are numbered
first; repeated rows each get a place; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.llm.common import documents, stored, table
from prlens.llm.feistel import permute
from prlens.llm.registry import register

KEY = "corpus-shuffle-1"
OVERHEAD = 16


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``row`` = 0..n-1 in the given order, and n.

    The order is fixed by a written table: partition and place of each row are
    columns of it, so a lost executor cannot renumber anything.  The driver
    holds one count for each range partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("place", 33).cast("int")
    counts = dict(placed.groupBy(part.alias("p")).count().collect())
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    starts = np.zeros(max(before, default=0) + 1, np.int64)
    starts[list(before)] = list(before.values())

    @F.pandas_udf("long")
    def row(place: pd.Series) -> pd.Series:
        p = place.to_numpy(np.int64)
        return pd.Series(starts[p >> 33] + (p & ((1 << 33) - 1)))

    return placed.withColumn("row", row("place")).drop("place"), total


def place_of(rows: np.ndarray, n: int, shards: int, key: str = KEY) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers."""
    p = permute(rows, n, key)
    return p % shards, p // shards


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, key: str = KEY) -> np.ndarray:
    """Row number in (shard, slot): the inverse of ``place_of``."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, key, back=True)


def shard_documents(docs: DataFrame, shards: int = 40, key: str = KEY) -> DataFrame:
    """doc_id, size, text_crc32, row, shard, slot."""
    rows = documents(docs).select("doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"),
                                  F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    placed, n = numbered(rows, "doc_id", "text_crc32", "size")

    @F.pandas_udf("shard int, slot long")
    def place(row: pd.Series) -> pd.DataFrame:
        shard, slot = place_of(row.to_numpy(np.int64), n, shards, key)
        return pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    return placed.withColumn("at", place("row")).select("doc_id", "size", "text_crc32", "row", "at.shard", "at.slot")


@register("op4_sharding")
def q_sharding(spark, sf_dir):
    """Operator 4: all documents into 40 shards."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row")
