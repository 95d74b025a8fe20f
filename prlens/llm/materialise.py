"""Operator 3: training-order materialisation into fixed-stride binary shards.

Texts become token ids and an end id, cut into sequences of SEQ_LEN tokens.
The written sequence table numbers them: a sequence's row number is its place
inside the task that made it plus the counts of earlier tasks (the driver holds
one count for each task).  A keyed Feistel permutation with cycle walking maps
the row number to a global slot; slots are cut into ranges of ``shard_records``,
one range is one file.  A record has a fixed stride (header and SEQ_LEN 16-bit
ids, zero padded), so slot s starts at byte (s mod shard_records) * stride of
shard s div shard_records: a reader resumes at any slot with one seek, and reads
on in training order without an index.

A task deals its sequences out by shard and sends them in compressed bundles
(ids do not repeat enough for the shuffle's own codec).  Bundles travel through
``repartitionById``: the permutation deals every source evenly over all shards.
Each shard is put in order and written by one task to a name of its own and
renamed, so a task that runs twice leaves one file.

Defined results: a null or empty text is one sequence with the end id alone; a
null doc_id is kept in the header as the smallest long; repeated rows each give
their sequences; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prlens.llm.common import documents, map_batches, stored, table
from prlens.llm.feistel import permute
from prlens.llm.registry import register
from prlens.llm.tokens import default_path, encoder
from prlens.session import checkpoint_dir

SEQ_LEN, END_ID, SHARD_RECORDS, KEY = 512, 49407, 8192, "training-order-1"
HEADER = struct.Struct("<qii")  # doc_id, number of the sequence in its document, tokens
NO_ID = -(1 << 63)


def stride(seq_len: int = SEQ_LEN) -> int:
    return HEADER.size + 2 * seq_len


def record(doc_id: int | None, seq_no: int, ids: bytes, seq_len: int) -> bytes:
    head = HEADER.pack(NO_ID if doc_id is None else doc_id, seq_no, len(ids) // 2)
    return head + ids.ljust(2 * seq_len, b"\0")


#: Bytes of ids in a row of the sequence table, compressed together.
TABLE_BYTES = 4 << 20


def _bundle(ints: np.ndarray, ids: bytes) -> bytes:
    """Numbers of sequences (a row for each kind, the last their bytes) and their ids end to
    end, compressed: ids do not repeat enough for smaller pieces."""
    head = np.array([ints.shape[1]], np.int64).tobytes()
    return zstandard.ZstdCompressor(6).compress(head + ints.astype(np.int64).tobytes() + ids)


def _opened(bundle: bytes, kinds: int) -> tuple[np.ndarray, memoryview]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(bundle))
    n = int(np.frombuffer(data[:8], np.int64)[0])
    return np.frombuffer(data[8:8 + 8 * kinds * n], np.int64).reshape(kinds, n), data[8 + 8 * kinds * n:]


def _sequences(path: str, seq_len: int, end_id: int):
    """Bundles of (doc_id, seq_no, bytes) and ids; ``place`` is the first row's number inside the task."""
    width, end = 2 * seq_len, end_id.to_bytes(2, "little")

    def run(batches):
        encode, task, made = encoder(path).encode, TaskContext.get().partitionId(), 0
        docs, parts, size = [], [], 0

        def out():
            sizes = np.array([len(p) for p in parts], np.int64)
            count = -(-sizes // width)
            first = np.repeat(np.cumsum(count) - count, count)
            number = np.arange(len(first)) - first
            ints = np.stack([np.repeat(np.array(docs, np.int64), count), number,
                             np.minimum(width, np.repeat(sizes, count) - number * width)])
            cols = {"task": pa.array([task], pa.int32()), "place": pa.array([made], pa.int64()),
                    "n": pa.array([len(first)], pa.int64()), "bundle": pa.array([_bundle(ints, b"".join(parts))], pa.binary())}
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                docs.append(NO_ID if doc_id is None else doc_id)
                parts.append(encode(text.as_py()) + end)
                size += len(parts[-1])
                if size > TABLE_BYTES:
                    yield (done := out())
                    made += done.column("n")[0].as_py()
                    docs, parts, size = [], [], 0
        if parts:
            yield out()
    return run


def _shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:07d}.bin"


#: Bytes of sequences a task holds before it sends its bundles.
BUNDLE_BYTES = 96 << 20


def _deal(starts: np.ndarray, total: int, key: str, records: int):
    """Sequences -> bundles of (slot, doc_id, seq_no, bytes) and ids by shard."""
    def run(batches):
        held: dict[int, list] = {}
        size = 0

        def out():
            rows = [(shard, _bundle(np.concatenate([i for i, _ in parts], axis=1), b"".join(x for _, x in parts)))
                    for shard, parts in sorted(held.items())]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)],
                ["shard", "bundle"])

        for batch in batches:
            for task, place, n, bundle in zip(*(batch.column(c).to_pylist() for c in ("task", "place", "n", "bundle")),
                                              strict=True):
                ints, ids = _opened(bundle, 3)
                slots = permute(starts[task] + place + np.arange(n), total, key)
                ends = np.cumsum(ints[2])
                order = np.argsort(slots // records, kind="stable")
                shards = (slots // records)[order]
                cuts = np.flatnonzero(np.diff(shards, prepend=-1)).tolist()
                full = np.concatenate([slots[None, :], ints])[:, order]
                spans = list(zip((ends - ints[2])[order].tolist(), ends[order].tolist(), strict=True))
                for i, j in zip(cuts, [*cuts[1:], n], strict=True):
                    held.setdefault(int(shards[i]), []).append((full[:, i:j], b"".join(ids[x:y] for x, y in spans[i:j])))
                size += len(ids)
                if size > BUNDLE_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()
    return run


def _write(folder: str, seq_len: int):
    """The bundles of whole shards -> shard files; yields the manifest."""
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)

        def write(shard, bundles):
            parts = [_opened(b, 4) for b in bundles]
            ints, ids = np.concatenate([i for i, _ in parts], axis=1), b"".join(x for _, x in parts)
            ends = np.cumsum(ints[3]).tolist()
            _, docs, numbers, sizes = ints.tolist()
            temp = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as out:
                for i in np.argsort(ints[0]).tolist():
                    out.write(record(docs[i], numbers[i], ids[ends[i] - sizes[i]:ends[i]], seq_len))
            fs.move(temp, _shard_path(root, shard))
            return shard, len(docs)

        at, bundles, done = None, [], []
        for batch in batches:
            for shard, bundle in zip(*(batch.column(c).to_pylist() for c in ("shard", "bundle")), strict=True):
                if shard != at and bundles:
                    done.append(write(at, bundles))
                    bundles = []
                at = shard
                bundles.append(bundle)
        if bundles:
            done.append(write(at, bundles))
        yield pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())],
            ["shard", "records"])
    return run


def materialise(docs: DataFrame, folder: str, path: str | None = None, key: str = KEY, seq_len: int = SEQ_LEN,
                end_id: int = END_ID, shard_records: int = SHARD_RECORDS) -> tuple[DataFrame, int]:
    """Write the shards into ``folder`` (a path or URI that all executors
    share); gives the manifest (shard, records) and the number of sequences."""
    made = stored(map_batches(documents(docs), _sequences(path or default_path(), seq_len, end_id),
                              "task int, place long, n long, bundle binary"), "sequences")
    counts = dict(made.groupBy("task").agg(F.sum("n")).collect())
    total = sum(counts.values())
    starts = np.zeros(max(counts, default=0) + 1, np.int64)
    before = 0
    for task in sorted(counts):
        starts[task] = before
        before += counts[task]

    shards = max(1, -(-total // shard_records))
    bundles = (map_batches(made, _deal(starts, total, key, shard_records), "shard int, bundle binary")
               .repartitionById(shards, "shard").sortWithinPartitions("shard"))
    manifest = stored(map_batches(bundles, _write(folder, seq_len), "shard long, records long"), "manifest")
    return manifest, total


def _parse(seq_len: int, records: int):
    def run(batches):
        size = stride(seq_len)
        kind = np.dtype([("doc_id", "<i8"), ("seq_no", "<i4"), ("n", "<i4"), ("ids", "<u2", (seq_len,))])
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard = int(os.path.basename(name)[6:-4])
                rec = np.frombuffer(content.as_buffer(), kind)
                slot = shard * records + np.arange(len(rec))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(len(rec), shard), pa.int64()), "slot": pa.array(slot, pa.int64()),
                    "byte_offset": pa.array(np.arange(len(rec)) * size, pa.int64()),
                    "doc_id": pa.array(rec["doc_id"], pa.int64(), mask=rec["doc_id"] == NO_ID),
                    "seq_no": pa.array(rec["seq_no"], pa.int32()), "n_tokens": pa.array(rec["n"], pa.int32()),
                    "ids": pa.array([r[:n].tobytes() for r, n in zip(rec["ids"], rec["n"], strict=True)], pa.binary())})
    return run


def read_shards(spark: SparkSession, folder: str, seq_len: int = SEQ_LEN,
                shard_records: int = SHARD_RECORDS) -> DataFrame:
    """shard, slot, byte_offset, doc_id, seq_no, n_tokens, ids of every record in the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    return map_batches(files.select("path", "content"), _parse(seq_len, shard_records),
                       "shard long, slot long, byte_offset long, doc_id long, seq_no int, n_tokens int, ids binary")


def read_from(folder: str, slot: int, seq_len: int = SEQ_LEN,
              shard_records: int = SHARD_RECORDS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(slot, doc_id, ids) in training order from ``slot`` on: one seek, then sequential reads."""
    fs, root = pafs.FileSystem.from_uri(folder)
    size = stride(seq_len)
    shard, skip = divmod(slot, shard_records)
    while fs.get_file_info(_shard_path(root, shard)).type == pafs.FileType.File:
        with fs.open_input_file(_shard_path(root, shard)) as f:
            f.seek(skip * size)
            while len(raw := f.read(size)) == size:
                doc_id, _, n = HEADER.unpack_from(raw)
                yield slot, doc_id, np.frombuffer(raw, "<u2", n, HEADER.size)
                slot += 1
        shard, skip = shard + 1, 0


@register("op3_training_order")
def q_training_order(spark, sf_dir):
    """Operator 3 over all documents, read back from the shard files."""
    folder = f"{checkpoint_dir(spark)}/llm-shards-{uuid.uuid4().hex}"
    _, total = materialise(table(spark, sf_dir, "documents"), folder)
    if not total:
        schema = "doc_id long, seq_no int, row long, slot long, shard long, byte_offset long, n_tokens int, ids_crc32 long"
        return spark.createDataFrame([], schema)

    @F.pandas_udf("row long, ids_crc32 long")
    def facts(slot: pd.Series, ids: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"row": permute(slot.to_numpy(np.int64), total, KEY, back=True),
                             "ids_crc32": [zlib.crc32(x) for x in ids]})

    return (read_shards(spark, folder).withColumn("f", facts("slot", "ids"))
            .select("doc_id", "seq_no", "f.row", "slot", "shard", "byte_offset", "n_tokens", "f.ids_crc32"))
