"""Operator 6: packing by cutting-stock column generation.

A document is its token ids and an end id.  Pieces of CAPACITY tokens fill a
sequence each; the rest of a document is one piece whose length, rounded up to
QUANTUM tokens, is its class.  The histogram of classes (at most
CAPACITY / QUANTUM numbers, whatever the corpus) is the cutting-stock problem:
the linear program over patterns is solved by column generation, where a
knapsack dynamic program prices new patterns, until no pattern can save more
than GAP.  Pattern counts are rounded down and what is left is packed greedily
into a few more patterns, so every piece has a place.

Pieces are ranked within their class (rank inside the task that made it plus
the counts of earlier tasks, so no class meets in one task), and rank plus the
pattern table give sequence and place directly.  The window that adds up offsets
inside a sequence moves numbers only; the ids rest in the piece table and are
joined by the piece's name where the caller wants them.

Defined results: a null or empty text is a document of the end id alone;
repeated rows are packed once for each row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prlens.llm.common import documents, map_batches, stored, table
from prlens.llm.registry import register
from prlens.llm.tokens import default_path, encoder

CAPACITY, QUANTUM, END_ID, GAP = 4096, 16, 2, 1e-3


def _cut(path: str, capacity: int, end_id: int):
    """Rows of pieces with class (0: a full piece) and rank inside class and task."""
    def run(batches):
        encode, task = encoder(path).encode, TaskContext.get().partitionId()
        made = np.zeros(capacity // QUANTUM + 2, np.int64)
        names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "task", "number", "class", "rank"]
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        end, number = end_id.to_bytes(2, "little"), 0
        for batch in batches:
            columns = [[] for _ in names]
            add = [c.append for c in columns]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                total = len(ids) // 2
                for at in range(0, total, capacity):
                    piece = ids if total <= capacity else ids[2 * at:2 * (at + capacity)]
                    n = len(piece) // 2
                    c = 0 if n == capacity else -(-n // QUANTUM)
                    crc = zlib.crc32(np.frombuffer(piece, "<u2").astype("<u4"))
                    for put, x in zip(add, (doc_id, at, n, total, crc, piece, task, number, c, int(made[c]))):
                        put(x)
                    made[c] += 1
                    number += 1
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)
    return run


def _price(value: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The most valuable pattern: how many of each size fit into ``room``."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        n = int(np.searchsorted(sizes, c, "right"))
        if n:
            got = best[c - sizes[:n]] + value[:n]
            i = int(np.argmax(got))
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts): whole numbers that meet ``demand`` exactly, by
    revised simplex on the linear program with priced columns, then rounding."""
    m = len(sizes)
    columns = np.diag(np.maximum(1, room // sizes)).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(50 * m + 200):
        duals = inverse.sum(axis=0)
        pattern = _price(duals, sizes, room)
        worth = float(duals @ pattern)
        if worth <= 1 + GAP:  # the bound z / worth is within GAP of z
            break
        step = inverse @ pattern
        can = step > 1e-9
        ratio = np.where(can, x / np.where(can, step, 1), np.inf)
        r = int(np.argmin(ratio))
        x = np.maximum(x - ratio[r] * step, 0)
        x[r] = ratio[r]
        columns[:, r] = pattern
        inverse[r] /= step[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(step[others], inverse[r])
    counts = np.floor(x + 1e-9).astype(np.int64)
    whole = columns.astype(np.int64).T
    while ((made := counts @ whole) > demand).any():  # rounding of the solver itself
        over = np.flatnonzero((made > demand) @ whole.T * counts)
        counts[over[0]] -= 1
    patterns, number, left = [*whole[counts > 0]], [*counts[counts > 0]], demand - made
    while left.any():
        pattern, space = np.zeros(m, np.int64), room
        for i in range(m - 1, -1, -1):
            pattern[i] = min(left[i], space // sizes[i])
            space -= pattern[i] * sizes[i]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        patterns.append(pattern)
        number.append(times)
        left = left - times * pattern
    return np.array(patterns, np.int64).reshape(-1, m), np.array(number, np.int64)


class Plan:
    """Where the piece of a class and rank goes."""

    def __init__(self, totals: dict[int, int], capacity: int):
        self.full = totals.get(0, 0)
        self.sizes = np.array(sorted(c for c in totals if c), np.int64)
        self.at = {int(c): i for i, c in enumerate(self.sizes)}
        demand = np.array([totals[int(c)] for c in self.sizes], np.int64)
        if len(demand):
            self.patterns, self.number = solve(self.sizes, demand, capacity // QUANTUM)
        else:
            self.patterns, self.number = np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
        self.first = self.full + np.concatenate([[0], np.cumsum(self.number)]).astype(np.int64)
        self.upto = np.cumsum(self.patterns * self.number[:, None], axis=0)

    def place(self, cls: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, order inside it)."""
        sequence, order = rank.copy(), np.zeros(len(rank), np.int64)
        for c in np.unique(cls[cls > 0]).tolist():
            i, rows = self.at[c], np.flatnonzero(cls == c)
            p = np.searchsorted(self.upto[:, i], rank[rows], "right")
            each = self.patterns[p, i]
            k = rank[rows] - (self.upto[p, i] - each * self.number[p])
            sequence[rows] = self.first[p] + k // each
            order[rows] = (len(self.sizes) - i) * CAPACITY + k % each
        return sequence, order


def pieces_of(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces, at rest: ids (binary, unsigned 16-bit little-endian) and their CRC-32 as unsigned 32-bit
    numbers, class and rank; (task, number) names a piece."""
    return stored(map_batches(documents(docs), _cut(path or default_path(), capacity, end_id),
                              "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary, "
                              "task int, number long, class int, rank long"), "pieces")


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids_crc32, task, number, sequence_id, offset; the ids stay where they are."""
    pieces = pieces.drop("ids")
    made = stored(pieces.groupBy("class", "task").count(), "histogram")
    totals = {r[0]: r[1] for r in made.groupBy("class").agg(F.sum("count")).collect()}
    plan = Plan(totals, capacity)
    earlier = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = made.select(F.col("class").alias("c2"), F.col("task").alias("t2"),
                         F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, place long")
    def place(cls: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, order = plan.place(cls.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "place": order})

    at = (pieces.join(before, (pieces["class"] == before.c2) & (pieces.task == before.t2))
          .withColumn("at", place("class", F.col("rank") + F.col("before"))))
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (at.select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "task", "number", "at.sequence_id", "at.place")
            .withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("place"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (binary, unsigned 16-bit little-endian), sequence_id, offset."""
    pieces = pieces_of(docs, path, capacity, end_id)
    ids = pieces.select(F.col("task").alias("t3"), F.col("number").alias("n3"), "ids")
    return (placed(pieces, capacity).join(ids, (F.col("task") == F.col("t3")) & (F.col("number") == F.col("n3")))
            .select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"))


def packed_rows(docs: DataFrame) -> DataFrame:
    """A row for each piece, its ids by their checksum."""
    return placed(pieces_of(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@register("op6_packing")
def q_packing(spark, sf_dir):
    """Operator 6 over all documents."""
    return packed_rows(table(spark, sf_dir, "documents"))
