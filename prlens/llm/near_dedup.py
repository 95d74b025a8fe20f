"""Operator 8: near-duplicates by circulant MinHash.

A document's set holds the hashes (64 bits) of its distinct k-word shingles.
Two permutations give all signature coordinates: sigma scatters a shingle over
2**32 places, pi ranks the places, and coordinate j is the minimum of pi over
the set shifted circularly by j.  Bands of ROWS coordinates make bucket keys;
there are as many bands as keep the chance to miss a pair at the threshold
under MISS.

Documents with the same set form one class and only its smallest doc_id goes
on.  Star links from each bucket's members to its smallest id (never pairs)
give candidate clusters.  A cluster is verified whole: its texts are read again
and all its pairs that can reach the threshold are compared on the full sets,
found through shared rare shingles (prefix filter, exact), skipping pairs that
are connected already.  A cluster over BLOCK_DOCS documents or BLOCK_SHINGLES
shingles is dealt into blocks by a hash, and each pair of blocks is a group of
its own, so no task holds more than two blocks.  Only confirmed links, at most one less than a group has
documents, leave a task; components of these links are the result.

Defined results: a text without words (or null) has an empty set and is linked
with nothing; repeated rows and equal texts are one class; rows that share a
doc_id are one document; a row with a null doc_id is linked with nothing, has a
null component and is kept; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.llm.common import documents, map_batches, stored, table
from prlens.llm.components import components
from prlens.llm.registry import register
from prlens.llm.words import space_words

ROWS, MISS = 5, 1e-6
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1_500_000

#: Word hashes kept by a worker (about 40 MB); forgotten and filled anew beyond.
MEMO_WORDS = 1 << 18


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter."""
    words = space_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        n = min(k, len(w))
        h = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - n + 1 + i]
        return np.unique(_mix(h + np.uint64(n)))


def n_bands(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold ** ROWS))


def signature(hashes: np.ndarray, coords: int) -> np.ndarray:
    """Circulant MinHash: coordinate j is min over x of pi(sigma(x) + j)."""
    sigma = (_mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coords, dtype=np.uint32)[:, None]
    out = np.full(coords, 0xFFFFFFFF, np.uint32)
    step = max(64, (1 << 16) // coords)
    for lo in range(0, len(sigma), step):
        p = sigma[None, lo:lo + step] + shift
        t = p >> np.uint32(16)
        p ^= t
        p *= np.uint32(0x85EBCA6B)
        np.right_shift(p, np.uint32(13), out=t)
        p ^= t
        p *= np.uint32(0xC2B2AE35)
        np.right_shift(p, np.uint32(16), out=t)
        p ^= t
        np.minimum(out, p.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(1, len(rows) + 1, dtype=np.uint64)
        for i in range(ROWS):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return h.view(np.int64)


def _sign(k: int, bands: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                sizes, digests, keys = [], [], []
                for text in batch.column("text"):
                    s = shingles(text.as_py(), k)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(band_keys(signature(s, bands * ROWS)) if len(s) else None)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()),
                    "digest": pa.array(digests, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})
    return run


def confirm(ids: list[int], blocks: list[int], sets: list[np.ndarray], num: int, den: int, cross: bool):
    """Confirmed links (a, b) that span the components of the group; with
    ``cross`` only pairs of different blocks are compared."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    _, flat, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(freq), np.int64)
    rank[np.argsort(freq, kind="stable")] = np.arange(len(freq))
    codes = np.split(rank[flat], np.cumsum(sizes)[:-1])
    block, label = np.array(blocks), np.arange(len(sets))
    mark = np.zeros(len(freq), bool)
    index: dict[int, list[int]] = {}
    for i in order.tolist():
        own, n = codes[i], int(sizes[i])
        # Of two sets at the threshold, the rarest n - ceil(t n) + 1 members of each have one in common.
        prefix = np.partition(own, m)[:m + 1] if (m := n - -(-num * n // den)) < n - 1 else own
        seen = [index[c] for c in prefix.tolist() if c in index]
        if seen:
            near = np.unique(np.concatenate([np.asarray(x) for x in seen]))
            near = near[(sizes[near] * den >= num * n) & (label[near] != label[i])]
            if cross:
                near = near[block[near] != block[i]]
            mark[own] = True
            for j in near.tolist():
                if label[j] == label[i]:
                    continue
                both = int(mark[codes[j]].sum())
                if den * both >= num * (n + int(sizes[j]) - both):
                    yield ids[i], ids[j]
                    label[label == label[j]] = label[i]
            mark[own] = False
        for c in prefix.tolist():
            index.setdefault(c, []).append(i)


def _verify(k: int, num: int, den: int):
    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "doc_id", "block")),
                           batch.column("text"), strict=True)

    def run(batches):
        with np.errstate(over="ignore"):
            found: list[tuple[int, int]] = []
            for (_, i, j), group in groupby(rows(batches), key=lambda r: r[:3]):
                members = [(r[3], r[4], shingles(r[5].as_py(), k)) for r in group]
                found += confirm(*map(list, zip(*members, strict=True)), num, den, i != j)
                if len(found) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
    return run


def near_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents are linked when
    den * intersection >= num * union of their k-word shingle sets."""
    rows = documents(docs)
    bands = n_bands(num / den)
    signed = stored(map_batches(rows, _sign(k, bands),
                                "doc_id long, n_shingles long, digest binary, bands array<long>"), "signatures")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
                                                  F.first("bands").alias("bands")), "classes")
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    buckets = (keyed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
               .filter("low != high").select(F.col("key").alias("key2"), "low"))
    stars = keyed.join(buckets, keyed.key == buckets.key2).select(F.col("rep").alias("a"), F.col("low").alias("b"))
    near = components(stars)
    sized = near.join(classes.select("rep", "n"), near.node == F.col("rep")).select("node", "component", "n")
    split = (sized.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
             .select(F.col("component").alias("cluster"), F.ceil(F.greatest(
                 F.col("c") / BLOCK_DOCS, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("parts")))
    members = stored(near.join(split, near.component == F.col("cluster")).select(
        "node", "cluster", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("block")), "clusters")
    groups = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(
        F.least("block", x).alias("i"), F.greatest("block", x).alias("j")))
    texts = (rows.join(members, rows.doc_id == members.node)
             .select("doc_id", "text", "cluster", "block", F.explode(groups).alias("g"))
             .select("cluster", "g.i", "g.j", "block", "doc_id", "text")
             .repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"))
    links = map_batches(texts, _verify(k, num, den), "a long, b long")
    linked = components(links)
    named = (classes.select(F.col("digest").alias("d2"), "rep").join(linked, F.col("rep") == linked.node, "left")
             .select("d2", F.coalesce("component", "rep").alias("found")))
    return (signed.join(named, (signed.digest == named.d2) & (signed.n_shingles > 0), "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
                    .alias("component_id"))
            .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id"))))


def drop_near(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group, with all its columns."""
    lost = near_dedup(docs, k, num, den).filter(~F.col("kept")).select(F.col("doc_id").alias("__lost_id")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == F.col("__lost_id"), "left_anti")


@register("op8_near_dedup", """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, k FROM (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 3) - 1], ' ') AS k
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS p FROM d WHERE len(w) > 0) t) u),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
          FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, g.c AS component_id, d.doc_id = g.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) g USING (doc_id)""")
def q_near_dedup(spark, sf_dir):
    """Operator 8 over all documents: three words, similarity 0.85."""
    return near_dedup(table(spark, sf_dir, "documents"), k=3, num=85)
