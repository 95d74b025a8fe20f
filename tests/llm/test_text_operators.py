"""Operators 1, 2, 8 and 9 against brute force."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as fx  # noqa: E402

from prlens.llm import components, decontaminate, exact_dedup, license_scan, near_dedup  # noqa: E402
from prlens.llm.common import prepare  # noqa: E402


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


def lower(t):
    return (t or "").encode().lower().decode()


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


# ---- 1


def dedup_truth(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_edges(spark):
    d = fx.docs(spark)
    got = exact_dedup.exact_dedup(d).drop("known").collect()
    assert sorted(map(tuple, got), key=repr) == dedup_truth([(r.doc_id, r.text) for r in d.collect()])
    assert exact_dedup.exact_dedup(fx.empty(spark)).count() == 0


def test_exact_dedup_with_history(spark):
    old, new = ["a", "b", "B", "c"], ["B", "d", "D", "a", "e"]
    history = spark.createDataFrame([(i, t) for i, t in enumerate(old)], "doc_id long, text string")
    docs = spark.createDataFrame([(10 + i, t) for i, t in enumerate(new)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.known) for r in exact_dedup.exact_dedup(docs, history).collect()}
    assert got == {10: (10, 3, True), 11: (12, 2, False), 12: (12, 2, False), 13: (13, 2, True), 14: (14, 1, False)}


def test_drop_repeats_keeps_columns(spark):
    d = fx.docs(spark)
    kept = exact_dedup.drop_repeats(d)
    assert kept.columns == d.columns
    texts = [lower(r.text) for r in kept.dropDuplicates(["doc_id", "text"]).collect()]
    assert len(texts) == len(set(texts)) == len({lower(r.text) for r in d.collect()})


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 20_000])
def test_perfect_hash_is_minimal(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    h = exact_dedup.PerfectHash(keys.copy())
    assert sorted(h.slots(keys.copy()).tolist()) == list(range(n))


def test_perfect_hash_lists_what_collides():
    keys = np.zeros((300, 32), np.uint8)  # the hashed words are equal: every level collides
    keys[:, 0] = np.arange(300) % 256
    keys[:, 1] = np.arange(300) // 256
    h = exact_dedup.PerfectHash(keys)
    assert len(h.rest) == 300 and sorted(h.slots(keys).tolist()) == list(range(300))


# ---- 2


def leak_truth(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = alnum(t), set(), set()
        for item, x in items:
            v = alnum(x)
            n = min(len(v), 10)
            wins = {tuple(v[p:p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p:p + n]) in wins:
                    hit.update(range(p, p + n))
                    found.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def leak_fixture(spark):
    rng = random.Random(2)
    items = [(k, fx.words(rng, n, 9)) for k, n in enumerate([40, 25, 12, 10, 9, 4, 1])]
    items += [(90, None), (91, " .,"), (3, "second text of item three has more words than ten in it"), (None, "É lone"),
              (92, "x x x x x x x x x x x x x x x")]
    texts = [None, "", fx.words(rng, 500, 9), "É, LONE!", "x " * 9, "x " * 10, "x " * 500]
    for _, x in items:
        v = (x or "").split()
        for a, b in ((0, 10), (1, 11), (3, 12), (2, 30), (0, 9), (0, 400)):
            texts.append(f"before {'... '.join(v[a:b])} after")
            texts.append(f"{' '.join(v[a:b]).upper()}{' '.join(v[a:b])}")
    docs = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[8])]
    return (docs, items, spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("limit", [1 << 22, 150])
def test_decontaminate(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", limit)
    docs, items, d, b = leak_fixture(spark)
    got = decontaminate.decontaminate(d, b).select("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated")
    assert sorted(map(tuple, got.collect()), key=repr) == leak_truth(docs, items)


def test_decontaminate_spans_point_into_the_text(spark):
    d = spark.createDataFrame([(1, "Änd — A b,C d e f;g h I   J ß!"), (2, "zzz")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a B c D e F g H i j ß")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(d, b).collect()}
    span = rows[1].spans[0]
    assert "Änd — A b,C d e f;g h I   J ß!"[span.start:span.end] == "A b,C d e f;g h I   J ß"
    assert (span.first, span.last, span.item, rows[2].spans) == (2, 12, "7", [])


def test_decontaminate_edges(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    d = fx.docs(spark)
    assert decontaminate.decontaminate(d, b).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(fx.empty(spark), b).count() == 0
    item = spark.createDataFrame([(1, "only without id")], "item_id long, text string")
    assert decontaminate.drop_leaks(d, item).count() == d.count() - 1
    assert decontaminate.drop_leaks(d, b).columns == d.columns


# ---- 8


def near_truth(rows, k, num, den):
    sets, ids = [], []
    for i, t in rows:
        if i is None:
            continue
        w = spaced(t)
        s = {tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.append(s)
        ids.append(i)
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                label[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in zip(ids, sets, strict=True))


def near_texts(seed, groups, size, length):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = fx.words(rng, length, 5000).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, length // 12))):
                w[rng.randrange(length)] = f"e{rng.randrange(10 ** 6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("k", "num", "block"), [(3, 85, 2048), (5, 80, 2048), (3, 85, 7)])
def test_near_dedup(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    texts = fx.edge_texts() + near_texts(1, 6, 25, 60) + near_texts(2, 20, 3, 30)
    d = fx.docs(spark, texts)
    got = near_dedup.near_dedup(d, k, num).collect()
    assert sorted(map(tuple, got)) == near_truth(list(enumerate(texts)), k, num, 100)


def test_near_dedup_edges(spark):
    d = fx.docs(spark)
    rows = near_dedup.near_dedup(d).collect()
    assert len(rows) == d.count()
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_dedup(fx.empty(spark)).count() == 0
    assert near_dedup.drop_near(d).columns == d.columns


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10 ** 6), 400)
    edges = [(a, b) for a, b in zip(ids[:300], ids[1:301], strict=True)] + [(ids[310], x) for x in ids[311:]]
    edges += [(ids[0], ids[0]), edges[5], edges[5][::-1], (None, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    want = {x: min(ids[:301]) for x in ids[:301]} | {x: min(ids[310:]) for x in ids[310:]}
    assert got == want


# ---- 9


def test_license_base_places(spark):
    texts = [None, "", "Under the MIT license; under the mit License.", "under the the mit license",
             "APACHE LICENSE, VERSION 2.0 cc-by-nc under the mit", "cc by cc by nc by nc",
             "a " * 9000 + "apache license version 2", "under the mit licensé"]
    got = {r.doc_id: r for r in license_scan.scan_licenses(fx.docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = alnum(t)
        at = [(p, label) for phrase, label in license_scan.PHRASES for p in range(len(w))
              if w[p:p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at)), t
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == sorted({x for _, x in at})
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert license_scan.scan_licenses(fx.empty(spark)).count() == 0
    assert license_scan.scan_licenses(fx.docs(spark)).count() == fx.docs(spark).count()


def test_license_templates():
    s = license_scan.scanner()
    for text, label in license_scan.TEMPLATES:
        w = text.encode().split()
        _, spans, score = s.scan([b"noise"] * 5 + w + [b"noise"])
        assert label in {x[0] for x in spans} and score == 1.0
        cut = w[:len(w) // 2] + [b"inserted", b"words"] + w[len(w) // 2:]
        if len(w) >= 12:
            assert label in {x[0] for x in s.scan(cut)[1]}
    assert s.scan([b"the", b"software", b"license", b"and", b"of"])[1:] == ([], 0.0)


def test_automaton_matching_statistics():
    rng = random.Random(4)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(6)]
    m = license_scan.SuffixAutomaton(seqs)
    subs = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    text = [rng.randrange(5) for _ in range(400)]
    state = length = 0
    for i, w in enumerate(text):
        state, length = m.step(state, length, w)
        best = max((n for n in range(1, 31) if n <= i + 1 and tuple(text[i + 1 - n:i + 1]) in subs), default=0)
        assert length == best
        for t, end in m.ends[state].items() if length else ():
            assert tuple(seqs[t][end - length + 1:end + 1]) == tuple(text[i + 1 - length:i + 1])


def test_phrases_of_one_or_two_words_are_found():
    from prlens.llm.license_scan import Scanner

    s = Scanner([("mit license", "mit"), ("wtfpl", "wtfpl")], [])
    base, _, _ = s.scan(b"under the mit license text or wtfpl".split())
    assert base == [(2, "mit"), (6, "wtfpl")]
