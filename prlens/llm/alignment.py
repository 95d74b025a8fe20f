"""Operator 13: alignment of two tokenizers over distinct texts.

Documents are shuffled by full text; each distinct text is tokenised by both
tokenizers and aligned once, and its pair counts are weighted by the number of
documents that hold it (a text held by a third of all rows is counted in each
map task first).

A is a byte-level BPE file over space + text, B a piece model that adds the
space itself.  Byte offsets where both end a token cut the tokens into groups;
each stretch between neighbouring ends of either is one link (the overlap of
one A and one B token holds no other end).  All texts of an Arrow batch are
aligned in one pass over flat arrays.

A block is a batch of texts of at most BLOCK_BYTES (one text where it is longer).
It keeps its distinct pairs, numbered, its links as those numbers, and its
texts' measures in one packed row, and gives one row (pair, count) for each
distinct pair.  Counts are summed by pair over the corpus, the highest of each B id is
found, and each block asks for its own pairs by an equi-join; the answers
return grouped by block (at most its distinct pairs) and give n_best and
count_sum of its texts.  Measures are joined to doc_ids by the text's SHA-256.

A's merges run in the fast BPE library over the vocabulary and merge order of
the A file (same ids), where the file is of that plain kind; any other file is
run by its own library.

Defined results: null and empty texts, and texts whose joined A or B bytes are
not space + text, have no tokens (zeros, '' for the groups) and count for
nothing; repeated rows count once each and each has its row; null doc_ids are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.llm.common import documents, map_batches, stored, table
from prlens.llm.registry import register

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"

BLOCK_BYTES = 4 << 20

#: Fixed value: how byte-level BPE files of this kind split a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


# ---- the tokenizers


def _byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Ids of space + text by a byte-level BPE file; ``pieces``: the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_of_letter()
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        # The fast library merges by id: right where the file's merges make the ids in their order.
        joined = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [vocab["".join(m)] for m in joined]
        pre = spec.get("pre_tokenizer") or {}
        same = (order == sorted(order) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                and not pre.get("add_prefix_space") and not spec.get("normalizer"))
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if same else None

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_ordinary(" " + text)
        return self.whole.encode(" " + text, add_special_tokens=False).ids


class Pieces:
    """Ids of a text by a piece model that adds the space; ``pieces``: the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i)
                       else n.replace("\u2581", " ").encode() for i, n in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


_LOADED: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def tokenizers(paths: tuple[str, str]) -> tuple[ByteLevel, Pieces]:
    if paths not in _LOADED:
        _LOADED[paths] = ByteLevel(paths[0]), Pieces(paths[1])
    return _LOADED[paths]


# ---- alignment


def _ends(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes[ids])


class Aligned:
    """Texts in a row, as one sequence of bytes: ends, groups and links of their tokens."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        self.n_a, self.n_b = (np.array([len(ids) for ids in x], np.int64) for x in (a, b))
        ends_a, ends_b = _ends(self.a, sizes_a), _ends(self.b, sizes_b)
        mark = np.zeros((int(ends_a[-1]) if len(ends_a) else 0) + 1, np.uint8)
        mark[ends_a] |= 1
        mark[ends_b] |= 2
        self.both_a, self.both_b = mark[ends_a] == 3, mark[ends_b] == 3
        kind = mark[np.flatnonzero(mark)]
        # The tokens over each stretch: those whose ends are still to come.
        over_a, over_b = np.cumsum(kind & 1) - (kind & 1), np.cumsum(kind >> 1) - (kind >> 1)
        self.link_a, self.link_b = self.a[over_a], self.b[over_b]
        self.n_groups = self._per_text(self.both_a, self.n_a)
        self.n_links = self.n_a + self.n_b - self.n_groups

    @staticmethod
    def _per_text(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        at = np.concatenate([[0], np.cumsum(counts)])
        return upto[at[1:]] - upto[at[:-1]]

    def groups_text(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        group_a = np.cumsum(self.both_a) - self.both_a
        group_b = np.cumsum(self.both_b) - self.both_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(self.a)) + (np.cumsum(size_b) - size_b)[group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(size_a)[group_b]
        names = _names(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)
        third = len(names) // 3
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[place_a] = self.a + third * self.both_a
        codes[place_b] = self.b + 2 * third * self.both_b
        written = names[codes]
        shown = written.view(np.uint8).reshape(len(written), -1) != 0
        upto = np.concatenate([[0], np.cumsum(shown.sum(axis=1))])
        flat = written.view(np.uint8)[shown.ravel()].tobytes()
        at = upto[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return [flat[i:j - 1] for i, j in zip(at, at[1:])]


_NAMES: list[np.ndarray] = [np.zeros(0, "S8")]


def _names(count: int) -> np.ndarray:
    """Every id in decimal with a comma, then each with a bar, then each with a semicolon (S8: below 10 ** 7)."""
    if count > 10_000_000:
        raise ValueError("ids of more than seven digits")
    if len(_NAMES[0]) < 3 * count:
        count = max(count, 1 << 16)
        _NAMES[0] = np.array([b"%d%c" % (i, c) for c in b",|;" for i in range(count)], "S8")
    return _NAMES[0]


def _pair_bits(b: Pieces) -> int:
    return max(1, (len(b.pieces) - 1).bit_length())


def _blocks(paths: tuple[str, str], block_bytes: int):
    """Rows (block, pair, n) and, for each block, (block, packed)."""
    def run(batches):
        a, b = tokenizers(paths)
        task, number = TaskContext.get().partitionId(), 0
        texts, times, size = [], [], 0
        for batch in batches:
            for text, n in zip(batch.column("text"), batch.column("times").to_pylist(), strict=True):
                texts.append(text.as_py())
                times.append(n)
                size += len(texts[-1])
                if size >= block_bytes:
                    yield from _block((task << 32) + number, texts, times, a, b)
                    number += 1
                    texts, times, size = [], [], 0
        if texts:
            yield from _block((task << 32) + number, texts, times, a, b)
    return run


def _joined(pieces: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(pieces.__getitem__, ids))


def _block(block: int, texts: list[str], times: list[int], a: ByteLevel, b: Pieces):
    digests, ids_a, ids_b, weight = [], [], [], []
    for text, n in zip(texts, times, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        x, y = a.encode(text), b.encode(text)
        if _joined(a.pieces, x) == (want := b" " + raw) == _joined(b.pieces, y):
            digests.append(hashlib.sha256(raw).digest())
            ids_a.append(np.array(x, np.int32))
            ids_b.append(np.array(y, np.int32))
            weight.append(n)
    if not digests:
        return
    sizes_a, sizes_b = (np.array([len(p) for p in t.pieces], np.int64) for t in (a, b))
    al = Aligned(ids_a, ids_b, sizes_a, sizes_b)
    del ids_a, ids_b
    groups = b"".join(hashlib.sha256(t).digest() for t in al.groups_text())
    link, pairs = pd.factorize((al.link_a.astype(np.int64) << _pair_bits(b)) | al.link_b)
    counts = np.zeros(len(pairs), np.int64)
    if max(weight) == 1:
        counts += np.bincount(link, minlength=len(pairs))
    else:  # whole numbers: sums of doubles would round beyond 2 ** 53
        by = np.repeat(np.array(weight, np.int64), al.n_links)
        for w in np.unique(by).tolist():
            counts += w * np.bincount(link[by == w], minlength=len(pairs))
    names = ["block", "pair", "at", "n", "texts", "digests", "groups", "measures", "links"]
    none = [pa.nulls(len(pairs), k) for k in (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(np.arange(len(pairs), dtype=np.int32)),
                                      pa.array(counts), *none], names)
    measures = np.stack([al.n_a, al.n_b, al.n_groups, al.n_links])
    yield pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()),
         pa.array([len(digests)], pa.int32()),
         *(pa.array([x], pa.binary()) for x in (b"".join(digests), groups, measures.astype(np.int64).tobytes(),
                                                link.astype(np.int32).tobytes()))], names)


def _measured(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """Rows of the texts of one block; ``answers``: (at, count, best) of its numbered pairs."""
    order = np.argsort(answers.column("at").to_numpy())
    count = answers.column("count").to_numpy()[order]
    best = answers.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    out = []
    for r in blocks.to_pylist():
        n = r["texts"]
        m = np.frombuffer(r["measures"], np.int64).reshape(4, n)
        link = np.frombuffer(r["links"], np.int32)
        at = np.concatenate([[0], np.cumsum(m[3])])
        sums = [np.concatenate([[0], np.cumsum(x[link])])[at] for x in (best, count)]
        out.append(pa.Table.from_pydict({
            "digest": pa.array([r["digests"][i:i + 32] for i in range(0, 32 * n, 32)], pa.binary()),
            **{k: pa.array(v) for k, v in zip(MEASURES, [*m, *(np.diff(s) for s in sums)], strict=True)},
            "groups_sha256": pa.array([r["groups"][i:i + 32].hex() for i in range(0, 32 * n, 32)])}))
    return pa.concat_tables(out)


RESULT = "digest binary, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string"


def pair_counts(blocks: DataFrame, bits: int) -> DataFrame:
    """(pair, count, best) over the corpus; best: no other pair of the B id counts more."""
    counts = stored(blocks.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b_id = F.col("pair").bitwiseAND((1 << bits) - 1)
    top = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("top"))
    return counts.join(top, b_id == F.col("b_id")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None,
          block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Measures (digest, n_a .. count_sum, groups_sha256) of each distinct text with tokens, and the corpus's
    pairs (a_id, b_id, count, best)."""
    paths = paths or default_paths()
    bits = _pair_bits(tokenizers(paths)[1])
    distinct = documents(docs).filter("text != ''").groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    blocks = stored(map_batches(distinct, _blocks(paths, block_bytes),
                                "block long, pair long, at int, n long, texts int, digests binary, groups binary, "
                                "measures binary, links binary"), "blocks")
    pairs = stored(pair_counts(blocks, bits), "pair-counts")
    asked = blocks.filter("pair IS NOT NULL").select("block", "at", "pair")
    answers = asked.join(pairs.hint("shuffle_merge"), "pair").select("block", "at", "count", "best")
    packed = blocks.filter("texts IS NOT NULL").select(
        F.col("block").alias("home"), "texts", "digests", "groups", "measures", "links")
    measures = packed.groupBy("home").cogroup(answers.groupBy("block")).applyInArrow(_measured, RESULT)
    return stored(measures, "measures"), pairs.select(
        F.expr(f"shiftright(pair, {bits})").alias("a_id"), F.col("pair").bitwiseAND((1 << bits) - 1).alias("b_id"),
        "count", "best")


def measured_documents(docs: DataFrame, measures: DataFrame) -> DataFrame:
    """One row for each document: doc_id and the measures of its text."""
    keyed = documents(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    joined = keyed.join(measures.hint("shuffle_merge"), "digest", "left")
    return joined.select("doc_id", *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES),
                         F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


@register("op13_alignment")
def q_alignment(spark, sf_dir):
    """Operator 13 over all documents."""
    docs = table(spark, sf_dir, "documents")
    return measured_documents(docs, align(docs)[0])
