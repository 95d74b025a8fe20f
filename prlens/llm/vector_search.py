"""Operator 11: exact top-k search over vector-approximation files.

Vectors become integer vectors, floor(64 * x) of each component; equal ones are
one class that remembers its k + 1 smallest ids (as many as one answer can
need).  Classes are dealt by hash into blocks of about VECTOR_BLOCK.  A block's
approximation file holds, per dimension, CELLS cells with about equally many
vectors: for each cell the smallest and largest value in it, for each vector
four bits that name its cell.  Its exact file holds the integer vectors.

1. Bounds: every block of queries meets the approximation file of every block
   of vectors.  Cell limits give each vector a lower and an upper bound of its
   score; each query's k + 1 largest lower bounds are merged over the blocks in a
   tree of bounded fan-in.  The last of them is the query's limit: no vector
   whose upper bound is below it can be an answer.
2. Reading: the approximations are scanned again with the limits.  A query
   reads the exact vectors of what is left in order of falling upper bound
   (a score is a reversed distance: this is the order of rising lower bounds of
   the distance) and stops when the (k + 1)-th best score read is above the
   next upper bound.  The answers of the blocks are merged in the same tree.

Work is queries times vectors, as any exact search; what moves is one copy of
a vector block for each query block and k + 1 answers for each query and
block, merged FANIN blocks at a time.  No task holds more than FANIN answers of
a query block or one pair of blocks.

Defined results: rows without an id, and vectors that are null or hold a null,
NaN or infinite component, take no part; vectors of different length are
compared as if the shorter ended in zeros (an empty vector scores 0 with all);
components beyond a long are cut to its ends, and so are scores (before they
are ranked); a row's own
is left out once, so a second row with its id and vector is an answer and each
repeated query row is answered; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prlens.llm.common import map_batches, stored, table
from prlens.llm.registry import register

K, QUERY_EVERY = 20, 20

#: Cells of a dimension (four bits), classes in a block of vectors, distinct
#: queries in a block of queries, blocks whose answers one merge takes, exact
#: vectors read at a time.
CELLS, VECTOR_BLOCK, QUERY_BLOCK, FANIN, READ = 16, 2048, 1024, 16, 64

#: Scores are longs; twice their ends, as bounds are twice the scores.
LONG, ENDS = (1 << 63) - 1, 2.0 ** 64


def integer_vector(embedding: Column) -> Column:
    """floor(64 * x) of each component as array<long>; null for a vector that takes no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & fit, F.transform(x, lambda v: F.floor(v * 64).cast("long")))


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, ints) of the rows that take part."""
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding")).alias("ints"))
            .filter("vec_id IS NOT NULL AND ints IS NOT NULL"))


# ---- arithmetic: floats where they are exact, else Python's whole numbers


def _kind(*largest: int) -> type:
    """The cheapest number type in which a sum of products of this size is exact."""
    size = 1
    for x in largest:
        size *= max(1, int(x))
    return np.float32 if size < 1 << 22 else np.float64 if size < 1 << 51 else object


def _largest(m: np.ndarray) -> int:
    return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0


def _as(m: np.ndarray, kind: type) -> np.ndarray:
    return m.astype(kind)


def _down(x: np.ndarray) -> np.ndarray:
    """As doubles that are not above ``x``."""
    return x.astype(np.float64) if x.dtype != object else np.nextafter(x.astype(np.float64), -np.inf)


# ---- files


def approximate(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, most: dim x CELLS values, codes: n x dim cells) of an integer matrix."""
    n, dim = m.shape
    codes = np.zeros((n, dim), np.uint8)
    least, most = np.zeros((dim, CELLS), np.int64), np.zeros((dim, CELLS), np.int64)
    for d in range(dim):
        column = m[:, d]
        edges = np.sort(column)[(np.arange(1, CELLS) * n) // CELLS]
        code = np.searchsorted(edges, column, "right")
        codes[:, d] = code
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        least[d, code[order[starts]]] = np.minimum.reduceat(column[order], starts)
        most[d, code[order[starts]]] = np.maximum.reduceat(column[order], starts)
    return least, most, codes


def _pack(codes: np.ndarray) -> bytes:
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return (even[:, ::2] << 4 | even[:, 1::2]).tobytes()


def _unpack(data: bytes, n: int, dim: int) -> np.ndarray:
    both = np.frombuffer(data, np.uint8).reshape(n, (dim + 1) // 2)
    return np.stack([both >> 4, both & 15], axis=2).reshape(n, -1)[:, :dim]


def bounds(q: np.ndarray, least: np.ndarray, most: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the lower and upper bounds of the scores, queries x vectors."""
    kind = _kind(4, codes.shape[1], _largest(q), max(_largest(least), _largest(most)))
    at = np.arange(codes.shape[1])[None, :]
    low, high = _as(least, kind)[at, codes], _as(most, kind)[at, codes]
    q = _as(q, kind)
    middle, width = q @ (low + high).T, np.abs(q) @ (high - low).T
    return middle - width, middle + width


def _matrix(ints: list, dim: int) -> np.ndarray:
    m = np.zeros((len(ints), dim), np.int64)
    for i, x in enumerate(ints):
        m[i, :len(x)] = x
    return m


def _vector_block(dim: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(rows["ints"].tolist(), dim)
        least, most, codes = approximate(m)
        ids = rows["ids"].tolist()
        return pd.DataFrame([{
            "vb": rows["vb"].iloc[0], "n": len(rows), "cells": least.tobytes() + most.tobytes(), "codes": _pack(codes),
            "exact": m.tobytes(), "counts": np.array([len(x) for x in ids], np.int64).tobytes(),
            "ids": np.concatenate(ids).astype(np.int64).tobytes()}])
    return build


def _query_block(dim: int):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"qb": rows["qb"].iloc[0], "m": len(rows),
                              "queries": _matrix(rows["ints"].tolist(), dim).tobytes()}])
    return build


# ---- the two scans


def _longs(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(*shape)


def _limits_of_pairs(dim: int, top: int):
    """Each query's ``top`` largest lower bounds in one block of vectors."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q, cells = _longs(r["queries"], r["m"], dim), _longs(r["cells"], 2, dim, CELLS)
                low, _ = bounds(q, cells[0], cells[1], _unpack(r["codes"], r["n"], dim))
                best = np.full((r["m"], top), -np.inf)
                keep = min(top, r["n"])
                best[:, :keep] = _down(np.partition(low, r["n"] - keep, axis=1)[:, r["n"] - keep:])
                yield pa.RecordBatch.from_pydict({"qb": pa.array([r["qb"]], pa.int64()),
                                                  "part": pa.array([r["vb"]], pa.int64()),
                                                  "low": pa.array([best.tobytes()], pa.binary())})
    return run


def _merge_limits(top: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        every = np.hstack([np.frombuffer(b, np.float64).reshape(-1, top) for b in rows["low"]])
        best = np.partition(every, every.shape[1] - top, axis=1)[:, every.shape[1] - top:]
        return pd.DataFrame([{"qb": rows["qb"].iloc[0], "part": rows["part"].iloc[0],
                              "low": np.ascontiguousarray(best).tobytes()}])
    return merge


def _cut_long(score: int) -> int:
    return max(-LONG - 1, min(LONG, int(score)))


def read_in_order(q: np.ndarray, upper: np.ndarray, limit: float, exact: np.ndarray, ids: list[np.ndarray],
                  top: int) -> tuple[list[tuple[int, int, bool]], int]:
    """The ``top`` best (score, id, own) of a block for one query and the number of exact vectors
    read: vectors in order of falling upper bound until the last answer is certain."""
    left = np.flatnonzero(upper >= limit)
    left = left[np.argsort(-upper[left], kind="stable")]
    best, count = [], 0
    while count < len(left):
        take = left[count:count + READ]
        count += len(take)
        scores = exact[take] @ q
        if len(best) == top:
            good = scores >= -best[-1][0]
            take, scores = take[good], scores[good]
        best += [(-_cut_long(s), v, i) for i, s in zip(take.tolist(), scores.tolist(), strict=True) for v in ids[i].tolist()]
        best = sorted(best)[:top]
        if len(best) == top and count < len(left) and -2 * best[-1][0] > upper[left[count]]:
            break
    own = {i: bool((exact[i] == q).all()) for _, _, i in best}
    return [(-s, v, own[i]) for s, v, i in best], count


def _answers_of_pairs(dim: int, top: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q, cells = _longs(r["queries"], r["m"], dim), _longs(r["cells"], 2, dim, CELLS)
                _, upper = bounds(q, cells[0], cells[1], _unpack(r["codes"], r["n"], dim))
                limit = np.clip(np.frombuffer(r["low"], np.float64).reshape(-1, top).min(axis=1), -ENDS, ENDS)
                exact = _longs(r["exact"], r["n"], dim)
                kind = _kind(dim, _largest(q), _largest(exact))
                exact, q = _as(exact, kind), _as(q, kind)
                ids = np.split(np.frombuffer(r["ids"], np.int64), np.cumsum(_longs(r["counts"], -1))[:-1])
                # Where sums are no machine numbers the limits are rounded down, which only lets more through.
                worth = upper if upper.dtype != object else np.clip(
                    np.nextafter(upper.astype(np.float64), np.inf), -ENDS, ENDS)
                yield _answer_rows(r["qb"], r["vb"], [
                    read_in_order(q[i], worth[i], limit[i], exact, ids, top) for i in range(r["m"])], top)
    return run


def _answer_rows(qb: int, part: int, found: list, top: int) -> pa.RecordBatch:
    hits = np.zeros((len(found), top, 3), np.int64)
    size = np.zeros(len(found), np.int64)
    for i, (best, _) in enumerate(found):
        size[i] = len(best)
        if best:
            hits[i, :len(best)] = best
    return pa.RecordBatch.from_pydict({
        "qb": pa.array([qb], pa.int64()), "part": pa.array([part], pa.int64()),
        "hits": pa.array([hits.tobytes()], pa.binary()), "size": pa.array([size.tobytes()], pa.binary()),
        "reads": pa.array([np.array([n for _, n in found], np.int64).tobytes()], pa.binary())})


def _merge_answers(top: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        hits = np.concatenate([_longs(b, -1, top, 3) for b in rows["hits"]], axis=1)
        size = np.stack([_longs(b, -1) for b in rows["size"]], axis=1)
        there = (np.arange(top)[None, None, :] < size[:, :, None]).reshape(len(hits), -1)
        # Present ones first, then higher scores (the complement reverses longs without overflow), then smaller ids.
        order = np.lexsort((hits[:, :, 1], ~hits[:, :, 0], ~there), axis=1)[:, :top]
        best = np.take_along_axis(hits, order[:, :, None], axis=1)
        return pd.DataFrame([{"qb": rows["qb"].iloc[0], "part": rows["part"].iloc[0],
                              "hits": np.ascontiguousarray(best).tobytes(),
                              "size": np.minimum(size.sum(axis=1), top).tobytes(),
                              "reads": np.sum([_longs(b, -1) for b in rows["reads"]], axis=0).tobytes()}])
    return merge


def _tree(parts: DataFrame, count: int, merge, schema: str) -> DataFrame:
    """Merge the parts 0 .. count - 1 of each query block, FANIN at a time, until one is left."""
    while count > 1:
        parts = (parts.withColumn("part", F.expr(f"part div {FANIN}")).groupBy("qb", "part")
                 .applyInPandas(merge, schema))
        count = -(-count // FANIN)
    return parts


def _result_rows(dim: int, top: int):
    """(ints padded to dim, hits, reads) of each distinct query."""
    def run(batches):
        hit = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64()), ("own", pa.bool_())]))
        for batch in batches:
            for r in batch.to_pylist():
                hits, size = _longs(r["hits"], r["m"], top, 3), _longs(r["size"], -1)
                yield pa.RecordBatch.from_pydict({
                    "ints": pa.array(list(_longs(r["queries"], r["m"], dim)), pa.list_(pa.int64())),
                    "hits": pa.array([[{"score": s, "vec_id": v, "own": bool(o)} for s, v, o in h[:n].tolist()]
                                      for h, n in zip(hits, size.tolist(), strict=True)], hit),
                    "n_read": pa.array(_longs(r["reads"], -1), pa.int64())})
    return run


def search(rows: DataFrame, query: Column, k: int = K, vector_block: int = VECTOR_BLOCK,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score, n_read) of the rows (vec_id, embedding) for which ``query`` (an
    expression on vec_id) holds: their ``k`` highest integer inner products with other rows.
    ``n_read``: exact vectors read for the query's vector."""
    spark, top = rows.sparkSession, k + 1
    every = vectors(rows)
    dim = every.agg(F.max(F.size("ints"))).first()[0] or 1
    pad = F.concat("ints", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("ints")))
    every = every.select("vec_id", pad.alias("ints"))
    # Only the smallest ids of a class: cut in each map task before the shuffle.
    first = Window.partitionBy("ints").orderBy("vec_id")
    classes = stored(every.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= top)
                     .groupBy("ints").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "classes")
    asked = stored(every.filter(query).select("ints").distinct(), "queries")
    n, m = classes.count(), asked.count()
    result = "query_id long, rank int, vec_id long, score long, n_read long"
    if not m:
        return spark.createDataFrame([], result)
    vbs, qbs = -(-n // vector_block), -(-m // query_block)
    deal = lambda count: F.pmod(F.xxhash64("ints"), F.lit(count))
    files = stored(classes.withColumn("vb", deal(vbs)).groupBy("vb").applyInPandas(
        _vector_block(dim), "vb long, n int, cells binary, codes binary, exact binary, counts binary, ids binary"),
        "files")
    blocks = stored(asked.withColumn("qb", deal(qbs)).groupBy("qb").applyInPandas(
        _query_block(dim), "qb long, m int, queries binary"), "queries")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        """Each block of queries beside each block of vectors: one row for each pair of numbers
        (the hash may leave a number without a block, and so without a row)."""
        left = left.withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vbs - 1).cast("long"))))
        right = right.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qbs - 1).cast("long"))))
        return left.join(right.hint("shuffle_merge"), ["qb", "vb"])

    low = map_batches(pairs(blocks, files.select("vb", "n", "cells", "codes")), _limits_of_pairs(dim, top),
                      "qb long, part long, low binary")
    limits = stored(_tree(low, vbs, _merge_limits(top), "qb long, part long, low binary").drop("part"), "limits")
    found = map_batches(pairs(blocks.join(limits, "qb"), files), _answers_of_pairs(dim, top),
                        "qb long, part long, hits binary, size binary, reads binary")
    found = stored(_tree(found, vbs, _merge_answers(top),
                         "qb long, part long, hits binary, size binary, reads binary").drop("part"), "answers")
    hits = map_batches(blocks.join(found, "qb"), _result_rows(dim, top),
                       "ints array<long>, hits array<struct<score:long,vec_id:long,own:boolean>>, n_read long")
    mine = F.array_position(F.transform("hits", lambda h: h.own & (h.vec_id == F.col("query_id"))), True)
    others = F.slice(F.filter("hits", lambda h, i: i + 1 != F.col("mine")), 1, k)
    return (every.filter(query).select(F.col("vec_id").alias("query_id"), "ints").join(hits, "ints")
            .withColumn("mine", mine).select("query_id", "n_read", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score", "n_read"))


OP11_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@register("op11_vector_search", OP11_SQL)
def q_vector_search(spark, sf_dir):
    """Operator 11 over all embeddings; queries are the ids divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0).drop("n_read")
