"""A7, near part: groups of files against brute-force Jaccard and union-find."""

import random

import pytest

from prlens.operators import components, scans

SCHEMA = "repo_name string, path string, content string"


def truth(rows):
    sets = {}
    for repo, path, text in rows:
        w = (text or "").split()
        n = min(5, len(w))
        sets[repo, path] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if a[0] == b[0] and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).append(k)
    return {(*k, r[1], len(m)) for r, m in groups.items() for k in m}


def found(spark, rows):
    got = scans.near_duplicate_files(spark.createDataFrame(rows, SCHEMA).repartition(4)).select(
        "repo_name", "path", "first_path", "n_docs").collect()
    assert len(got) == len(rows)
    return {tuple(r) for r in got}


def words(rng, n, pool=10_000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def edited(rng, text, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in text]


def test_copies_edits_and_odd_texts(spark):
    rng = random.Random(1)
    rows = []
    for f in range(12):
        base = words(rng, rng.randrange(3, 300))
        rows += [(f"r{f % 2}", f"f{f}-{i}", " ".join(edited(rng, base, share)))
                 for i, share in enumerate([0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1])]
    rows += [("r0", "z1", ""), ("r0", "z2", None), ("r0", "z3", "one two"), ("r0", "z4", " one\ntwo "), ("r1", "z5", "a")]
    assert found(spark, rows) == truth(rows)


def test_relatives_that_sort_first_hide_no_pair(spark):
    """A pair at 0.8 or more among sixty files that share boilerplate below 0.8."""
    rng = random.Random(2)
    rows = []
    for repo in range(6):
        boiler = words(rng, 150)
        rows += [(f"r{repo}", f"a{i:02d}", " ".join(boiler + words(rng, 60))) for i in range(60)]
        pair = boiler + words(rng, 60)
        rows += [(f"r{repo}", "z1", " ".join(pair)), (f"r{repo}", "z2", " ".join([*pair[:-1], "other"]))]
    got = found(spark, rows)
    assert got == truth(rows)
    assert sum(r[1:] == ("z2", "z1", 2) for r in got) == 6


def test_a_chain_is_one_group(spark):
    """a is near b and b near c, a and c are not."""
    rng = random.Random(3)
    rows = []
    for repo in range(10):
        t = words(rng, 120)
        rows += [(f"r{repo}", p, " ".join(t[s:s + 100])) for p, s in (("a", 0), ("b", 10), ("c", 20))]
    got = found(spark, rows)
    assert got == truth(rows) and {r[3] for r in got} == {3}


@pytest.mark.parametrize("nodes", [1, 2, 40])
def test_components(spark, nodes):
    links = [(i, i + 1) for i in range(nodes - 1)] + [(100, 101), (101, 100), (102, 102), (105, 103), (103, 104), (None, 3)]
    random.Random(4).shuffle(links)
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {(i, 0) for i in range(nodes) if nodes > 1} | {(100, 100), (101, 100), (103, 103), (104, 103), (105, 103)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_files_near_none_go_no_further(spark, monkeypatch):
    """The shingles of files that have no near file are not moved, and no file of a pair is left out."""
    rng = random.Random(5)
    rows = []
    for f in range(60):
        base = words(rng, rng.randrange(3, 400))
        rows += [("r", f"f{f:02d}-{i}", " ".join(edited(rng, base, share))) for i, share in enumerate([0, 0.01, 0.02, 0.04])]
    lone = words(rng, 15)
    rows += [("r", f"lone{i:03d}", " ".join(lone + words(rng, 300, 10**6))) for i in range(200)]
    tables, written = {}, scans.written

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]
    monkeypatch.setattr(scans, "written", kept)
    want = truth(rows)
    assert found(spark, rows) == want
    stay = {r["path"] for r in tables["arrays"].select("path").collect()}
    same = {r["path"]: r["rep"] for r in tables["classes"].collect()}
    classes = {}
    for r in want:
        classes.setdefault(r[2], set()).add(same.get(r[1]))
    assert {c for group in classes.values() if len(group) > 1 for c in group} <= stay
    assert not any(path.startswith("lone") for path in stay)


def test_rows_of_a_path_are_one_set(spark):
    rng = random.Random(6)
    t, u = words(rng, 100), words(rng, 100)
    rows = [("r", "a", " ".join(t)), ("r", "a", " ".join(t)), ("r", "b", " ".join([*t[:-1], "x"])),
            ("r", "c", " ".join(u[:60])), ("r", "c", " ".join(u[50:])), ("r", "d", " ".join(u)),
            ("r", "e", " ".join(words(rng, 100))), ("r", "e", " ".join(words(rng, 100))),
            ("r", "f", " ".join(words(rng, 96))), ("r", "f", None), (None, "a", " ".join(t)), ("r", None, " ".join(t))]
    got = scans.near_duplicate_files(spark.createDataFrame(rows, SCHEMA).repartition(3)).select(
        "repo_name", "path", "first_path", "n_docs").collect()
    assert sorted(tuple(r) for r in got) == [
        ("r", "a", "a", 2), ("r", "b", "a", 2), ("r", "c", "c", 2), ("r", "d", "c", 2), ("r", "e", "e", 1), ("r", "f", "f", 1)]


def test_any_sizes_and_edits_against_brute_force(spark):
    """Sets at every similarity about the threshold, with boilerplate in most of them."""
    rng = random.Random(7)
    boiler = words(rng, 30)
    rows = []
    for f in range(80):
        base = boiler * (f % 2) + words(rng, rng.randrange(1, 160), 40 if f % 5 == 0 else 10_000)
        for i in range(4):
            text = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 25)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            cut = rng.randrange(0, 1 + len(text) // 6)
            rows.append((f"r{f % 3}", f"f{f}-{i}", " ".join(text[cut:])))
    assert found(spark, rows) == truth(rows)
