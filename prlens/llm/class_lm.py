"""Operator 7: Brown class-based bigram model by exchange clustering.

Tokens are lower-cased white-space words and one end per document.  Documents
are encoded in blocks of about BLOCK_TOKENS tokens with a dictionary of their
own, so words cross the network once for each block and not once for each token.
Word counts are a grouped sum over all dictionaries; they are joined back to
the dictionaries, and each block turns its documents into streams of units.

Words are dealt into buckets by a hash.  Blocks and the places of words in them
are written once, bucketed by block and by word bucket, so that a pass over the
corpus moves only the labels of each block's words.  A unit is the end, one of the TOP_WORDS
most frequent words, or the band of all other words with the same number of
binary digits in their count.  Units only give the start: exchange clustering of
the unit bigrams of all training text moves each unit to the class that raises
the likelihood of the class bigram model most, until no unit moves or SWEEPS are over.

Then ROUNDS of distributed exchange place every training word by its own
neighbours.  Each block counts (word, class before) and (word, class after) for
all its words; the counts are summed by bucket of words, and each word takes its
best class, with the same gain as above.  A round's words move at once, so a
round that lowers the likelihood is undone and is the last.  Only the grid of
classes by classes is on the driver.  Unseen words belong to the lowest band's
class.  A text scores P(class | class before) * P(word | class) for each token,
both smoothed with 0.1; the end stands before the first word.

Defined results: a null or empty text is one end; documents with a null doc_id
train (their remainder is unknown); repeated rows count and score each; without
any training document every count is 0; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.llm.common import bucketed, documents, map_batches, stored, table
from prlens.llm.registry import register
from prlens.llm.words import space_words

BLOCK_TOKENS = 4_000_000
TOP_WORDS, BANDS, CLASSES, SWEEPS, ROUNDS, ADD = 512, 48, 48, 12, 3, 0.1
END = b""
NO_ID = -(1 << 63)
#: Distinct (block, word) places of a bucket, about; words of one gain batch; cells of a dense count.
BUCKET_PLACES, GAIN_WORDS, DENSE = 400_000, 256, 1 << 24
#: Cells of a word: class before, class after, itself after itself.
CELLS = 2 * CLASSES + 1


def _encode(batches):
    """Block rows: documents as ids of the block's own dictionary (the end is id 0)."""
    task, made = TaskContext.get().partitionId(), 0
    pack = zstandard.ZstdCompressor(1).compress

    def fresh():
        d = defaultdict(int)
        d.default_factory = d.__len__
        assert d[END] == 0
        return d, [], [], []

    def block():
        sizes = np.array([len(s) for s in streams], np.int64)
        train = [s for s, h in zip(streams, held, strict=True) if not h]
        counts = np.bincount(np.concatenate(train), minlength=len(words)) if train else np.zeros(len(words), np.int64)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([(task << 32) + made], pa.int64()),
            "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
            "held": pa.array([np.array(held, np.uint8).tobytes()], pa.binary()),
            "sizes": pa.array([sizes.tobytes()], pa.binary()),
            "stream": pa.array([pack(np.concatenate(streams).astype("<u4").tobytes())], pa.binary()),
            "words": pa.array([list(words)], pa.list_(pa.binary())),
            "counts": pa.array([counts], pa.list_(pa.int64()))})

    words, ids, held, streams = fresh()
    tokens = 0
    for batch in batches:
        for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(),
                                     batch.column("text"), strict=True):
            own = space_words(text.as_py())
            own.append(END)
            ids.append(NO_ID if doc_id is None else doc_id)
            held.append(out)
            streams.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
            tokens += len(own)
            if tokens >= BLOCK_TOKENS:
                yield block()
                words, ids, held, streams = fresh()
                tokens, made = 0, made + 1
    if ids:
        yield block()


def _places(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's words, numbered: a row for each block, and one (block -1) for the bucket."""
    code, words = pd.factorize(rows["word"])
    n = rows["n"].to_numpy(np.int64)
    c = np.zeros(len(words), np.int64)
    np.add.at(c, code, n)
    bucket, out = int(rows["bucket"].iloc[0]), []
    at, local = rows["block"].to_numpy(np.int64), rows["local"].to_numpy(np.int64)
    order = np.lexsort([local, at])
    for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        out.append((bucket, int(at[part[0]]), local[part].astype("<u4").tobytes(), code[part].astype("<u4").tobytes(),
                    c[code[part]].tobytes(), None, None, None, None))
    end = next((i for i, w in enumerate(words) if w == END), -1)
    best = sorted((i for i in range(len(words)) if i != end and c[i] > 0), key=lambda i: (-c[i], words[i]))[:TOP_WORDS]
    out.append((bucket, -1, None, None, c.tobytes(), [bytes(words[i]) for i in best], [int(c[i]) for i in best], best, end))
    return pd.DataFrame(out, columns=["bucket", "block", "local", "idx", "c", "top", "top_c", "top_idx", "end_idx"])


def _by_block(places: pa.Table) -> pa.Table:
    """All places of a block in one row, in the order of their buckets."""
    places = places.sort_by("bucket")
    joined = {k: places.column(k).to_pylist() for k in ("local", "idx", "c")}
    return pa.table({
        "block": places.column("block").slice(0, 1), "buckets": pa.array([places.column("bucket").to_pylist()], pa.list_(pa.int64())),
        "n": pa.array([[len(x) // 4 for x in joined["local"]]], pa.list_(pa.int32())),
        **{k: pa.array([b"".join(x)], pa.binary()) for k, x in joined.items()}})


def _start(named: dict[tuple[int, int], int]):
    """First labels of each bucket's words: their units."""
    def run(batches):
        for batch in batches:
            labels = []
            for bucket, c, end in zip(*(batch.column(k).to_pylist() for k in ("bucket", "c", "end_idx")), strict=True):
                c = np.frombuffer(c, np.int64)
                unit = TOP_WORDS + 1 + np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), BANDS - 1)
                for (b, i), u in named.items():
                    if b == bucket:
                        unit[i] = u
                if end >= 0:
                    unit[end] = 0
                labels.append(unit.astype("<u2").tobytes())
            yield pa.RecordBatch.from_pydict({"bucket": batch.column("bucket"), "labels": pa.array(labels, pa.binary())})
    return run


def _relabel(cls: np.ndarray):
    def run(batches):
        for batch in batches:
            new = [cls[np.frombuffer(x, "<u2")].astype("<u2").tobytes() for x in batch.column("labels").to_pylist()]
            yield pa.RecordBatch.from_pydict({"bucket": batch.column("bucket"), "labels": pa.array(new, pa.binary())})
    return run


def _deliver(places: pa.Table, state: pa.Table) -> pa.Table:
    """The bucket's labels for each block that has words of it."""
    labels = np.frombuffer(state.column("labels")[0].as_py(), "<u2") if state.num_rows else np.zeros(0, "<u2")
    return pa.table({"block": places.column("block"), "bucket": places.column("bucket"), "labels": pa.array(
        [labels[np.frombuffer(x, "<u4")].tobytes() for x in places.column("idx").to_pylist()], pa.binary())})


class _Block:
    """One block with the labels of its dictionary."""

    def __init__(self, blocks: pa.Table, labels: pa.Table):
        row = blocks.to_pylist()[0]
        self.row, self.sizes = row, np.frombuffer(row["sizes"], np.int64)
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.stream = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["stream"]), "<u4")
        self.local = np.frombuffer(row["local"], "<u4")
        self.n_words = len(self.local)
        self.labels = self.spread(np.frombuffer(b"".join(labels.sort_by("bucket").column("labels").to_pylist()), "<u2"))

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values in the order of the places, by local word."""
        out = np.zeros(self.n_words, values.dtype)
        out[self.local] = values
        return out

    def train(self) -> np.ndarray:
        return self.stream[np.repeat(~self.held, self.sizes)]


def _pair_counts(n: int):
    """Counts of label pairs of a block's training text."""
    def run(blocks: pa.Table, labels: pa.Table) -> pa.Table:
        sums = np.zeros(n * n, np.int64)
        if blocks.num_rows:
            block = _Block(blocks, labels)
            u = block.labels[block.train()].astype(np.int64)
            if len(u):  # each stream ends with the end, so the next one begins after it
                sums += np.bincount(_before(u) * n + u, minlength=n * n)
        at = np.flatnonzero(sums)
        return pa.table({"pair": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})
    return run


def _sum_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _neighbours(blocks: pa.Table, labels: pa.Table) -> pa.Table:
    """A block's (word, neighbour class) counts, packed for each bucket, and its class pairs (bucket -1)."""
    out = {"bucket": [], "keys": [], "counts": [], "grid": []}
    if blocks.num_rows:
        block = _Block(blocks, labels)
        t = block.train().astype(np.int64)
        if len(t):
            c = block.labels[t].astype(np.int64)
            before, word = _before(c), t != 0  # the end (local 0) never moves
            out["bucket"].append(-1)
            out["keys"].append(None)
            out["counts"].append(None)
            out["grid"].append(np.bincount(before * CLASSES + c, minlength=CLASSES ** 2).tolist())
            after, twice = np.roll(c, -1), np.concatenate([[False], (t[1:] == t[:-1]) & word[1:]])
            keys = np.concatenate([(t * CELLS + before)[word], (t * CELLS + CLASSES + after)[word],
                                   (t * CELLS + 2 * CLASSES)[twice]])
            if block.n_words * CELLS <= DENSE:
                sums = np.bincount(keys)
                keys = np.flatnonzero(sums)
                sums = sums[keys]
            else:
                keys, sums = np.unique(keys, return_counts=True)
            buckets = block.row["buckets"]
            of = block.spread(np.repeat(np.arange(len(buckets)), block.row["n"]))
            idx = block.spread(np.frombuffer(block.row["idx"], "<u4")).astype(np.int64)
            w = keys // CELLS
            order = np.argsort(of[w], kind="stable")
            keys, sums, part = (idx[w] * CELLS + keys % CELLS)[order], sums[order], of[w][order]
            pack = zstandard.ZstdCompressor(1).compress
            for x in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if len(x):
                    k, n = _sum_keys(keys[x], sums[x])
                    out["bucket"].append(buckets[int(part[x[0]])])
                    out["keys"].append(pack(np.diff(k, prepend=0).astype("<u4").tobytes()))
                    out["counts"].append(pack(n.astype("<u4").tobytes()))
                    out["grid"].append(None)
    return pa.table([pa.array(out["bucket"], pa.int64()), pa.array(out["keys"], pa.binary()),
                     pa.array(out["counts"], pa.binary()), pa.array(out["grid"], pa.list_(pa.int64()))], list(out))


def gains(grid: np.ndarray, cls: np.ndarray, into: np.ndarray, out: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What each class would gain by each word, the word itself taken out of its
    class before (as in ``exchange``).  into, out: (word, class) counts without
    the ``own`` pairs of the word with itself."""
    at = np.arange(len(cls))
    g, base = np.repeat(grid[None], len(cls), 0), np.repeat(_xlogx(grid)[None], len(cls), 0)
    g[at, cls] -= out
    g[at, :, cls] -= into
    g[at, cls, cls] -= own
    base[at, cls], base[at, :, cls] = _xlogx(g[at, cls]), _xlogx(g[at, :, cls])
    rows, cols, d = g.sum(axis=2) + into, g.sum(axis=1) + out, np.diagonal(g, axis1=1, axis2=2)
    gain = (_xlogx(d + out + into + own[:, None]) - _xlogx(d) + _xlogx(rows) + _xlogx(cols)
            - _xlogx(rows + (out.sum(axis=1) + own)[:, None]) - _xlogx(cols + (into.sum(axis=1) + own)[:, None]))
    for side, cells in ((out, lambda m, w, j: m[w, :, j]), (into, lambda m, w, j: m[w, j])):
        w, j = np.nonzero(side)
        if len(w):
            v = _xlogx(cells(g, w, j) + side[w, j][:, None]) - cells(base, w, j)
            v[np.arange(len(w)), j] = 0  # the diagonal is counted above
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            gain[w[first]] += np.add.reduceat(v, first, axis=0)
    gain[:, 0] = -np.inf
    return gain


def _move(grid: np.ndarray):
    """Each word of a bucket goes to its best class."""
    def run(stats: pa.Table, state: pa.Table) -> pa.Table:
        if not stats.num_rows:
            return state
        unpack = zstandard.ZstdDecompressor().decompress
        keys = np.concatenate([np.cumsum(np.frombuffer(unpack(x), "<u4"), dtype=np.int64)
                               for x in stats.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(unpack(x), "<u4") for x in stats.column("counts").to_pylist()])
        keys, counts = _sum_keys(keys, counts.astype(np.int64))
        labels = np.frombuffer(state.column("labels")[0].as_py(), "<u2").copy()
        word, cell = keys // CELLS, keys % CELLS
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        last = np.append(first[1:], len(word))
        # Words with the same class and the same counts get the same answer.
        alike: dict[bytes, list[int]] = {}
        small = np.stack([cell, counts], axis=1).astype("<u4")
        for k, (lo, hi) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            alike.setdefault(labels[word[lo]].tobytes() + small[lo:hi].tobytes(), []).append(k)
        groups = list(alike.values())
        for lo in range(0, len(groups), GAIN_WORDS):
            some = groups[lo:lo + GAIN_WORDS]
            full = np.zeros((len(some), CELLS))
            for r, ks in enumerate(some):
                full[r, cell[first[ks[0]]:last[ks[0]]]] = counts[first[ks[0]]:last[ks[0]]]
            a = labels[word[first[[ks[0] for ks in some]]]].astype(np.int64)
            own, at = full[:, -1], np.arange(len(some))
            into, out = full[:, :CLASSES], full[:, CLASSES:-1]
            into[at, a] -= own
            out[at, a] -= own
            gain = gains(grid, a, into, out, own)
            b, stay = gain.argmax(axis=1), gain[at, a]
            b = np.where(gain[at, b] <= stay + 1e-6 * (1 + np.abs(stay)), a, b)
            for ks, to in zip(some, b.tolist(), strict=True):
                labels[word[first[ks]]] = to
        return pa.table({"bucket": state.column("bucket"), "labels": pa.array([labels.tobytes()], pa.binary())})
    return run


def _documents(blocks: pa.Table, labels: pa.Table) -> pa.Table:
    """Documents of a block as class streams, with the sums that need each word's count."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "units"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
    if not blocks.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    block = _Block(blocks, labels)
    count, stream, sizes = block.spread(np.frombuffer(block.row["c"], np.int64)), block.stream, block.sizes
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    units = block.labels.astype(np.uint8)[stream]
    cols = [[None if x == NO_ID else x for x in np.frombuffer(block.row["ids"], np.int64).tolist()], block.held, sizes,
            np.add.reduceat((count > 0)[stream], starts, dtype=np.int64),
            np.add.reduceat(np.log10(count + ADD)[stream], starts),
            [units[a:a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]]
    return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names)


def _class_sums(bucket: pa.Table, state: pa.Table) -> pa.Table:
    """Training words and tokens of each class in a bucket."""
    n, c = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    if bucket.num_rows:
        count = np.frombuffer(bucket.column("c")[0].as_py(), np.int64)
        labels = np.frombuffer(state.column("labels")[0].as_py(), "<u2")
        n += np.bincount(labels[count > 0], minlength=CLASSES)
        np.add.at(c, labels, count)
    return pa.table({"cls": pa.array(range(CLASSES), pa.int64()), "n": pa.array(n), "c": pa.array(c)})


def _before(units: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], units[:-1]])


def _bigrams(n_units: int):
    def run(batches):
        sums = np.zeros(n_units * n_units, np.int64)
        for batch in batches:
            train = [np.frombuffer(units.as_buffer(), np.uint8)
                     for held, units in zip(batch.column("held_out").to_pylist(), batch.column("units"), strict=True)
                     if not held]
            if train:  # each stream ends with the end, so the next one begins after it
                u = np.concatenate(train).astype(np.int64)
                sums += np.bincount(_before(u) * n_units + u, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int64()), "n": pa.array(sums[at], pa.int64())})
    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit.  Unit 0 (the end) keeps a class of its own; the
    others start dealt out by frequency and move while the likelihood rises."""
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    cls = np.zeros(n, np.int64)
    order = 1 + np.argsort(-weight[1:], kind="stable")
    cls[order] = 1 + np.arange(n - 1) % (classes - 1)
    member = np.eye(classes)[cls]
    grid = member.T @ bigrams @ member
    for _ in range(sweeps):
        moved = 0
        for u in order[weight[order] > 0].tolist():
            a, own = int(cls[u]), float(bigrams[u, u])
            out, into = bigrams[u] @ member, bigrams[:, u] @ member
            out[a] -= own
            into[a] -= own
            grid[a] -= out
            grid[:, a] -= into
            grid[a, a] -= own
            rows, cols = grid.sum(axis=1) + into, grid.sum(axis=0) + out  # the word's neighbours keep these pairs
            gain_out = _xlogx(grid + out[None, :]) - _xlogx(grid)
            gain_in = _xlogx(grid + into[:, None]) - _xlogx(grid)
            d = np.diag(grid)
            gain = (gain_out.sum(axis=1) - np.diag(gain_out) + gain_in.sum(axis=0) - np.diag(gain_in)
                    + _xlogx(d + out + into + own) - _xlogx(d)
                    - _xlogx(rows + out.sum() + own) + _xlogx(rows) - _xlogx(cols + into.sum() + own) + _xlogx(cols))
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-6 * (1 + abs(gain[a])):
                b = a
            moved += b != a
            cls[u] = b
            member[u] = 0
            member[u, b] = 1
            grid[b] += out
            grid[:, b] += into
            grid[b, b] += own
        if not moved:
            break
    return cls


def _score(step: np.ndarray, spread: np.ndarray, base: float):
    def run(batches):
        for batch in batches:
            model, plain = [], []
            for n, logs, units in zip(batch.column("n_tokens").to_pylist(), batch.column("log_counts").to_pylist(),
                                      batch.column("units"), strict=True):
                c = np.frombuffer(units.as_buffer(), np.uint8)
                model.append(logs + float(step[_before(c), c].sum() - spread[c].sum()))
                plain.append(logs - n * base)
            keep = {k: batch.column(k) for k in ("doc_id", "held_out", "n_tokens", "n_known")}
            yield pa.RecordBatch.from_pydict(keep | {"base_score": pa.array(plain, pa.float64()),
                                                     "score": pa.array(model, pa.float64())})
    return run


def _grid(pairs: DataFrame, n: int) -> np.ndarray:
    """Sums of (pair, n) rows as a matrix (at most n ** 2 numbers reach the driver)."""
    grid = np.zeros(n * n)
    seen = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    grid[seen["pair"].to_numpy(np.int64)] = seen["n"].to_numpy(np.float64)
    return grid.reshape(n, n)


def likelihood(grid: np.ndarray) -> float:
    """Of the class bigrams, without the words' own part, which no move changes."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(axis=0)).sum() - _xlogx(grid.sum(axis=1)).sum())


class Corpus:
    """Blocks, and the places of each bucket's words in them."""

    def __init__(self, docs: DataFrame):
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))
        blocks = bucketed(map_batches(documents(docs).withColumn("held_out", out), _encode,
                                      "block long, ids binary, held binary, sizes binary, stream binary, "
                                      "words array<binary>, counts array<long>"), "blocks", "block", parts)
        n = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
        words = (blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w"))
                 .select("block", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
                 .withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(max(12, -(-n // BUCKET_PLACES))))))
        places = bucketed(words.groupBy("bucket").applyInPandas(
            _places, "bucket long, block long, local binary, idx binary, c binary, top array<binary>, "
                     "top_c array<long>, top_idx array<long>, end_idx long"), "places", "bucket", parts)
        self.places, self.buckets = places.filter("block >= 0"), places.filter("block < 0")
        at = bucketed(self.places.select("block", "bucket", "local", "idx", "c").groupBy("block").applyInArrow(
            lambda x: _by_block(x), "block long, buckets array<long>, n array<int>, local binary, idx binary, c binary"),
            "block-places", "block", parts)
        self.blocks = blocks.drop("words", "counts").join(at.hint("merge"), "block")  # both by block: no exchange

    def start(self) -> DataFrame:
        """(bucket, labels): the units of all words."""
        top = (self.buckets.select("bucket", F.explode(F.arrays_zip("top", "top_c", "top_idx")).alias("t"))
               .orderBy(F.desc("t.top_c"), "t.top").limit(TOP_WORDS).select("bucket", "t.top_idx").collect())
        named = {(b, i): u for u, (b, i) in enumerate(top, 1)}
        return stored(map_batches(self.buckets.select("bucket", "c", "end_idx"), _start(named),
                                  "bucket long, labels binary"), "labels")

    def over(self, state: DataFrame, fn, schema: str, *extra: str) -> DataFrame:
        """fn(block with the columns ``extra``, the labels of its words) for each block."""
        labels = self.places.select("bucket", "block", "idx").groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(
            lambda a, b: _deliver(a, b), "block long, bucket long, labels binary")
        blocks = self.blocks.select("block", "held", "sizes", "stream", "local", *extra)
        return blocks.groupBy("block").cogroup(labels.groupBy("block")).applyInArrow(lambda a, b: fn(a, b), schema)


def cluster(corpus: Corpus) -> tuple[DataFrame, int]:
    """((bucket, labels): the class of every word, class of unseen words)."""
    n_units = TOP_WORDS + 1 + BANDS
    state = corpus.start()
    seed = exchange(_grid(corpus.over(state, _pair_counts(n_units), "pair long, n long"), n_units))
    state = stored(map_batches(state, _relabel(seed), "bucket long, labels binary"), "labels")
    before, best = state, -np.inf
    for k in range(ROUNDS + 1):
        if k == ROUNDS:  # only to see whether the last round raised the likelihood
            grid = _grid(corpus.over(state, _pair_counts(CLASSES), "pair long, n long"), CLASSES)
        else:
            stats = stored(corpus.over(state, _neighbours, "bucket long, keys binary, counts binary, grid array<long>",
                                       "buckets", "n", "idx"), "neighbours")
            grid = _grid(stats.filter("bucket < 0").select(F.posexplode("grid").alias("pair", "n")), CLASSES)
        if likelihood(grid) <= best:
            state = before
            break
        best = likelihood(grid)
        if k < ROUNDS:
            moved = stats.filter("bucket >= 0").select("bucket", "keys", "counts").groupBy("bucket").cogroup(
                state.groupBy("bucket")).applyInArrow((lambda f: lambda a, b: f(a, b))(_move(grid)), "bucket long, labels binary")
            before, state = state, stored(moved, "labels")
    return state, int(seed[TOP_WORDS + 1])


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    corpus = Corpus(docs)
    state, unseen = cluster(corpus)
    streams = stored(corpus.over(state, _documents, "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                 "log_counts double, units binary", "ids", "c"), "classes")
    moves = _grid(map_batches(streams.select("held_out", "units"), _bigrams(CLASSES), "pair long, n long"), CLASSES)
    step = np.log10((moves + ADD) / (moves.sum(axis=1, keepdims=True) + ADD * CLASSES))
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in (corpus.buckets.select("bucket", "c").groupBy("bucket").cogroup(state.groupBy("bucket"))
              .applyInArrow(lambda a, b: _class_sums(a, b), "cls long, n long, c long")
              .groupBy("cls").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()):
        types[r["cls"]], tokens[r["cls"]] = r["n"], r["c"]
    total, distinct = int(tokens.sum()), int(types.sum())
    types[unseen] += 1
    spread = np.log10(np.maximum(tokens + ADD * types, ADD))
    base = float(np.log10(total + ADD * (distinct + 1)))
    scored = map_batches(streams, _score(step, spread, base), "doc_id long, held_out boolean, n_tokens long, "
                         "n_known long, base_score double, score double")
    return (scored.withColumn("train_tokens", F.lit(total).cast("long"))
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))


@register("op7_class_lm")
def q_class_lm(spark, sf_dir):
    """Operator 7 over all documents."""
    return score_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
