"""Operators 11, 12, 13 against brute force; edge cases of each."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as fx  # noqa: E402

from prlens.llm import alignment, prefix_trie, vector_search  # noqa: E402
from prlens.llm.common import prepare  # noqa: E402


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


# ---- 11

VECTORS = "vec_id long, embedding array<double>, ints string, hits string, score string"


def vector_rows(rng):
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(300)]
    same = [0.1, -0.2, 0.3, 0.4, -0.5, 0.6]
    rows += [(1000 + i, same) for i in range(90)]  # more copies than one answer holds
    rows += [(20, same), (1000, same), (1000, same)]  # repeated ids, with another and with the same vector
    rows += [(2000, None), (2020, [0.1, None]), (2040, [float("nan"), 1.0]), (2060, [float("inf")]), (None, same)]
    rows += [(2100, []), (2120, [0.5]), (2140, [0.25] * 9)]  # other lengths
    return rows


def search_truth(rows, k, every):
    ints = [(v, [math.floor(64 * x) for x in e]) for v, e in rows
            if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, (q, a) in enumerate(ints):
        if q % every == 0:
            best = sorted((-vector_search._cut_long(sum(x * y for x, y in zip(a, b))), v) for j, (v, b) in enumerate(ints) if j != i)[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(best)]
    return Counter(out)


@pytest.mark.parametrize("k,block", [(20, 40), (3, 1000), (500, 64)])
def test_vector_search_against_brute_force(spark, k, block):
    rows = vector_rows(random.Random(1))
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], VECTORS).repartition(7)
    got = vector_search.search(df, F.col("vec_id") % 20 == 0, k, vector_block=block, query_block=16).collect()
    assert Counter(tuple(r)[:4] for r in got) == search_truth(rows, k, 20)


def test_vector_search_of_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randrange(-3, 40) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_search.search(df, F.col("vec_id") % 20 == 0, 5, vector_block=30).collect()
    most = vector_search.LONG
    assert Counter(tuple(r)[:4] for r in got) == search_truth(rows, 5, 20)
    assert any(r.score == most for r in got)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])],
                                 "vec_id long, embedding array<double>")
    got = vector_search.search(huge, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, most), (2, -most - 1)]


def test_vector_search_reads_few_exact_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    m = np.concatenate([c + 0.05 * rng.normal(size=(50, 16)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = vector_search.search(df, F.col("vec_id") % 20 == 0, 5).collect()
    assert max(r.n_read for r in got) < len(m) / 4


def test_vector_search_bounds_hold():
    rng = np.random.default_rng(4)
    m, q = rng.integers(-50, 50, (200, 7)), rng.integers(-50, 50, (9, 7))
    m[:, 3] = 5  # one value: one cell
    least, most, codes = vector_search.approximate(m)
    assert (vector_search._unpack(vector_search._pack(codes), 200, 7) == codes).all()
    low, high = vector_search.bounds(q, least, most, codes)
    exact = 2 * (q @ m.T)
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 2 * np.abs(q).sum(1).mean() * 12


def test_vector_search_of_nothing(spark):
    for rows in ([], [(1, [0.5])], [(20, None)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert vector_search.search(df, F.col("vec_id") % 20 == 0).collect() == []


# ---- 12

CHATS = "conv_id long, turn long, role string, text string, path string, depth string, digest string"


def chat_rows(rng):
    rows = []
    for c in [*range(0, 40), *range(95, 140), *range(200, 203), 305, 411, -7, -250, -200]:
        texts = [rng.choice(["hi", "é中", "", None, "a" * rng.randrange(3)]) for _ in range(rng.randrange(1, 9))]
        rows += [(c, t, rng.choice(["user", "assistant"]), x) for t, x in enumerate(texts)]
    long = [(t, "user", f"turn {t}") for t in range(150)]
    rows += [(c, *r) for c in (1001, 1002, 1003) for r in long[:150 if c < 1003 else 120]]  # a long shared prefix
    rows += [(1004, t, "user", f"other {t}") for t in range(200)]
    rows += [(50, None, None, "null turn"), (50, None, None, "another"), (50, 1, "user", "x"), (50, 1, "user", "x"),
             (None, 0, "user", "no conversation"), (60, 0, "ab", "c"), (61, 0, "a", "bc")]
    return rows


def rebuild_truth(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said = f"{len(role or '')}:{role or ''}{text or ''}".encode()
            convs[c].append((t is not None, t or 0, hashlib.sha256(said).digest(), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def trie_truth(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], CHATS).repartition(5)
    out = prefix_trie.trie(*prefix_trie.rebuilt(df)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return Counter(tuple(r) for r in out.collect())


def test_prefix_trie_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_RUN", 3)
    rows = chat_rows(random.Random(4))
    convs = rebuild_truth(rows)
    assert any(not t for t in convs.values())  # turnless ones are members of the root
    assert trie_rows(spark, rows) == trie_truth(convs)


def test_prefix_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1, 400) if c % 100 for t in range(3)]
    assert trie_rows(spark, rows) == trie_truth(rebuild_truth(rows))
    assert trie_rows(spark, [(5, 0, None, None)]) == trie_truth(rebuild_truth([(5, 0, None, None)]))
    assert trie_rows(spark, []) == Counter()


# ---- 13


def align_truth(rows):
    a, b = alignment.tokenizers(alignment.default_paths())
    per, pairs = [], Counter()
    for doc_id, text in rows:
        if not text:
            per.append((doc_id, None))
            continue
        whole = b" " + text.encode()
        x, y = a.whole.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
        if b"".join(a.pieces[i] for i in x) != whole or b"".join(b.pieces[i] for i in y) != whole:
            per.append((doc_id, None))
            continue

        def spans(ids, pieces):
            ends = np.cumsum([len(pieces[i]) for i in ids]).tolist()
            return list(zip([0, *ends[:-1]], ends))
        sx, sy = spans(x, a.pieces), spans(y, b.pieces)
        links, j0 = [], 0
        for i, (s, e) in enumerate(sx):
            while sy[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(sy) and sy[j][0] < e:
                links.append((x[i], y[j]))
                j += 1
        cuts = sorted({e for _, e in sx} & {e for _, e in sy})
        groups, i, j = [], 0, 0
        for cut in cuts:
            i2 = next(n for n in range(i, len(sx)) if sx[n][1] == cut) + 1
            j2 = next(n for n in range(j, len(sy)) if sy[n][1] == cut) + 1
            groups.append(",".join(map(str, x[i:i2])) + "|" + ",".join(map(str, y[j:j2])))
            i, j = i2, j2
        per.append((doc_id, (len(x), len(y), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
        pairs.update(links)
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    return Counter((d, 0, 0, 0, 0, 0, 0, "") if m is None else
                   (d, m[0], m[1], m[2], len(m[3]), sum(pairs[p] == top[p[1]] for p in m[3]), sum(pairs[p] for p in m[3]), m[4])
                   for d, m in per), pairs


ODD = ["a▁b", "<0x0A> </s><s> <unk> <|endoftext|>", "\n  x\n \n y  ", " ", "   ", "👍🏽 中文 \x00\x01", "x" * 3000,
       "don't we'LL ''s", "\x85a\xa0b　c"]


@pytest.mark.parametrize("block", [1, 2000, alignment.BLOCK_BYTES])
def test_alignment_against_brute_force(spark, block):
    docs = fx.docs(spark, [*fx.edge_texts(), *ODD, ODD[1], ODD[1], None]).repartition(3)
    measures, pairs = alignment.align(docs, block_bytes=block)
    got = Counter(tuple(r) for r in alignment.measured_documents(docs, measures).collect())
    want, counts = align_truth([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want
    assert {(r.a_id, r.b_id): r["count"] for r in pairs.collect()} == dict(counts)


def test_alignment_tokens_equal_the_libraries():
    a, b = alignment.tokenizers(alignment.default_paths())
    assert a.fast is not None
    for t in [x or "" for x in fx.edge_texts()] + ODD + ["\n" * 3000, "ŉ İstanbul ΣΑΣ ½ １２", "a​b\x1c \x1f"]:
        assert a.encode(t) == a.whole.encode(" " + t, add_special_tokens=False).ids, t
        assert b.encode(t) == b.model.encode(t), t


def test_alignment_of_nothing(spark):
    for docs in (fx.empty(spark), fx.docs(spark, [None, "", "▁"])):
        measures, pairs = alignment.align(docs)
        rows = alignment.measured_documents(docs, measures).collect()
        assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in rows) and len(rows) == docs.count()
        assert pairs.count() == 0
