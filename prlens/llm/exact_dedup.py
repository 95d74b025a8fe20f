"""Operator 1: exact deduplication over a minimal perfect hash of history.

Texts are equal when they are identical after lower-casing A-Z.  A digest
(SHA-256 of the normalised text) stands for a text.  The digests of the loaded
history are dealt into shards by their first bytes; each shard holds a minimal
perfect hash (levels of collision-free bits, about three bits a digest) whose
slots keep the full digest, the winner's locator (largest doc_id) and the
number of rows.  Incoming rows are first combined per digest on the map side
(a text that fills a third of the table reaches its shard once for each map
task), then looked up: a slot counts only if all 32 bytes agree.  Members fold
into their slot; nonmembers form groups of their own.

Defined results: a null text is the empty text; rows with a null doc_id count
in their group and win only if the group has no other id (then ``keep_id`` is
null and they stay); rows that repeat doc_id and text are the same row twice
and share its verdict; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.llm.common import documents, lower_az, stored, table
from prlens.llm.registry import register

#: Digests in a shard (its hash and slots take about 60 bytes each).
SHARD_KEYS = 50_000
#: Bits of a level for each key left, and levels before the rest is listed.
GAMMA, LEVELS = 1.5, 24


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = digests.view("<u8").reshape(-1, 4)
    return w[:, 1], w[:, 2]


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = a + b * np.uint64(2 * level + 1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests onto 0..n-1."""

    def __init__(self, digests: np.ndarray):
        a, b = _words(digests)
        left = np.arange(len(digests))
        self.levels: list[np.ndarray] = []
        self.before = [0]
        while len(left) and len(self.levels) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            at = _place(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append(alone)
            self.before.append(self.before[-1] + int(alone.sum()))
            left = left[~alone[at]]
        self.ranks = [np.cumsum(x) - 1 for x in self.levels]
        self.rest = {digests[i].tobytes(): self.before[-1] + k for k, i in enumerate(left)}

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest; any slot, or -1, for a nonmember."""
        a, b = _words(digests)
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for k, bits in enumerate(self.levels):
            at = _place(a[left], b[left], k, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        for i in left if self.rest else ():
            out[i] = self.rest.get(digests[i].tobytes(), -1)
        return out


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(-1, 32).copy()


def _look_up(new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """A shard's history becomes slots; the shard's incoming digests are looked
    up.  Gives a row for every digest of either side."""
    keys, probes = _matrix(old["digest"]), _matrix(new["digest"])
    ids, counts = old["locator"].astype("Int64").copy(), old["n"].to_numpy(np.int64).copy()
    own = np.ones(len(new), bool)
    if len(old):
        mph = PerfectHash(keys)
        slot = mph.slots(keys)
        where = np.empty(len(old), np.int64)
        where[slot] = np.arange(len(old))
        got = mph.slots(probes)
        row = where[np.maximum(got, 0)]
        same = (got >= 0) & (keys[row] == probes).all(axis=1)
        row, own = row[same], ~same
        counts[row] += new["n"].to_numpy(np.int64)[same]
        pair = pd.concat([ids.iloc[row].reset_index(drop=True),
                          new["locator"].astype("Int64")[same].reset_index(drop=True)], axis=1)
        ids.iloc[row] = pair.max(axis=1).astype("Int64").to_numpy()
    rest = new[own]
    return pd.DataFrame({
        "digest": [*old["digest"], *rest["digest"]],
        "keep_id": pd.concat([ids, rest["locator"].astype("Int64")], ignore_index=True),
        "group_size": np.concatenate([counts, rest["n"].to_numpy(np.int64)]),
        "known": np.arange(len(old) + len(rest)) < len(old)})


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("locator"), F.count(F.lit(1)).alias("n"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest of the normalised text)."""
    return documents(docs).select("doc_id", F.unhex(F.sha2(lower_az(F.col("text")).cast("binary"), 256)).alias("digest"))


def resolve(incoming: DataFrame, history: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size, known) of every digest in ``incoming``
    (doc_id, digest rows) and ``history`` (doc_id, digest rows)."""
    new, old = _grouped(incoming), _grouped(history)
    total = incoming.count() + history.count()
    shards = 1 << max(5, math.ceil(math.log2(max(1, total / SHARD_KEYS))))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards))
    return (new.withColumn("shard", shard).groupBy("shard")
            .cogroup(old.withColumn("shard", shard).groupBy("shard"))
            .applyInPandas(lambda a, b: _look_up(a, b),
                           "digest binary, keep_id long, group_size long, known boolean"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per document of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256, known (the text was in the history).

    ``history`` is an earlier documents table; its rows count in the groups but
    are not returned.  Without one, the rows up to the middle of the doc_id
    range are the loaded history and the others arrive after it.
    """
    rows = stored(digests(docs), "digests")
    if history is None:
        span = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        middle = None if span[0] is None else (span[0] + span[1]) // 2
        early = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False)) if middle is not None else F.lit(False)
        verdicts = resolve(rows.filter(~early), rows.filter(early))
    else:
        verdicts = resolve(rows, digests(history))
    verdicts = stored(verdicts, "verdicts").withColumnRenamed("digest", "d2")
    return (rows.join(verdicts, rows.digest == verdicts.d2)
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "known"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    lost = (exact_dedup(docs).filter(~F.col("kept"))
            .select(F.col("doc_id").alias("__lost_id"), F.col("text_sha256").alias("__lost_text")).distinct())
    text = F.sha2(lower_az(F.coalesce(docs["text"].cast("string"), F.lit(""))).cast("binary"), 256)
    return docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(F.col("__lost_id"))
                     & (text == F.col("__lost_text")), "left_anti")


@register("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents) d
WINDOW w AS (PARTITION BY t)""")
def q_exact_dedup(spark, sf_dir):
    """Operator 1 over all documents."""
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")
