"""Operator 10 against the same posterior computed in memory, a row at a time."""

import math
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("prlens.llm")

from prlens.llm import language_id as lid  # noqa: E402

WORDS = {"en": "the cat sat on a mat and then it ran home with us".split(),
         "fr": "le chat est sur la table où il dort très bien été".split(),
         "de": "die katze schläft über dem haus und träumt nicht mehr".split()}
HOSTS = ["a.example.org", "b.example.org", "x.net", "localhost", "", None, "News.Example.ORG", "y.z.x.net"]


def made(seed=11, n=240):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(["en", "en", "en", "fr", "de"])
        words = [rng.choice(WORDS[lang if rng.random() < 0.8 else rng.choice(list(WORDS))]) for _ in range(rng.randint(1, 30))]
        text = rng.choice([" ", ", ", "\n"]).join(words)
        rows.append((i, text.title() if i % 7 == 0 else text, rng.choice([lang, lang, lang.upper() + "-xx", None, "tlh", "en"]),
                     rng.choice(HOSTS[:3] if lang == "en" else HOSTS)))
    rows += [(n, None, "en", "x.net"), (n + 1, "", "fr", "only.empty.se"), (n + 2, "...", None, None),
             (n + 3, "xq zw jk vv qx kz wj", None, "x.net"), (n + 4, "die " * 4000, "de", "x.net"), rows[0], rows[0]]
    return rows


def grams(text):
    kept = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = "".join(c if not c.isascii() or c.isalnum() else " " for c in kept).split(" ")
    raw = (" " + " ".join(w for w in words if w) + " ").encode()
    if not raw.strip():
        return Counter()
    return Counter(int.from_bytes(raw[i:i + 3], "big") * 2654435761 % 2 ** 32 >> 16 for i in range(len(raw) - 2))


def code(x):
    letters = ""
    for c in (x or "").strip():
        if not (c.isascii() and c.isalpha()):
            break
        letters += c.lower()
    return letters


def truth(rows):
    """[(language, posterior, text language, kept)] of (id, text, declared, host) rows that are labelled by their declaration."""
    seen = [grams(r[1]) for r in rows]
    names = sorted({code(r[2]) for r in rows if r[1] is not None} - {""})
    counts = {x: Counter() for x in names}
    own = [code(r[2]) if r[1] is not None and code(r[2]) else None for r in rows]
    for g, x in zip(seen, own, strict=True):
        if x:
            counts[x].update(g)
    total = {x: sum(counts[x].values()) + 0.5 * 65536 for x in names}

    alone = defaultdict(list)
    for g, x in zip(seen, own, strict=True):
        n = sum(g.values())
        if x and n:
            logs = [(math.log((counts[x][b] - k + 0.5) / (total[x] - n)), k) for b, k in g.items()]
            mean = sum(v * k for v, k in logs) / n
            alone[x].append((mean, sum(v * v * k for v, k in logs) / n - mean ** 2))
    floor, spread = {}, {}
    for x, parts in alone.items():
        mean = sum(m for m, _ in parts) / len(parts)
        floor[x] = mean - 8 * math.sqrt(sum((m - mean) ** 2 for m, _ in parts) / len(parts))
        spread[x] = 8 * math.sqrt(max(sum(v for _, v in parts) / len(parts), 0))

    text = [[sum(k * math.log((counts[x][b] + 0.5) / total[x]) for b, k in g.items()) for x in names] for g in seen]
    vote = [max(range(len(names)), key=lambda i: (t[i], -i)) if g else None for g, t in zip(seen, text, strict=True)]
    said = [code(r[2]) if code(r[2]) in names else "other" if code(r[2]) else "none" for r in rows]
    pairs = Counter((d, v) for d, v in zip(said, vote, strict=True) if v is not None)
    kinds = len(names) + 2

    host = [(r[3] or "").lower() for r in rows]
    domain = {h: ".".join(h.split(".")[-2:]) for h in host}
    suffix = {h: h.split(".")[-1] for h in host}
    levels = [Counter(), Counter(), Counter(), Counter()]
    for h, v in zip(host, vote, strict=True):
        if v is not None:
            for level, place in zip(levels, (h, (suffix[h], domain[h]), suffix[h], ""), strict=True):
                level[place, v] += 1

    def prior(h):
        whole = [levels[3]["", i] for i in range(len(names))]
        p = [(c + 1) / (sum(whole) + len(names)) for c in whole]
        for level, place in ((2, suffix[h]), (1, (suffix[h], domain[h])), (0, h)):
            c = [levels[level][place, i] for i in range(len(names))]
            p = [(a + 5 * b) / (sum(c) + 5) for a, b in zip(c, p, strict=True)]
        return p

    out = []
    for g, t, v, d, h in zip(seen, text, vote, said, host, strict=True):
        if not g:
            out.append((None, None, None, False))
            continue
        logs = [0.3 * t[i] + math.log(p) + math.log((pairs[d, i] + 1) / (sum(n for (_, j), n in pairs.items() if j == i) + kinds))
                for i, p in enumerate(prior(h))]
        weights = [math.exp(x - max(logs)) for x in logs]
        i, n = weights.index(max(weights)), sum(g.values())
        x, posterior = names[i], max(weights) / sum(weights)
        like = t[i] / n >= floor[x] - spread[x] / math.sqrt(n)
        out.append((x, posterior, names[v], like and posterior >= 0.5))
    return out


def test_posteriors_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnRenamed("lang", "declared")
    labelled = df.select("doc_id", "text", df.declared.alias("lang"))
    got = lid.identify(df.withColumnRenamed("source", "host"), lid.fit(labelled)).collect()
    want = {r[0]: w for r, w in zip(rows, truth(rows), strict=True)}
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert len({r.language for r in got}) > 3 and {r.kept for r in got} == {True, False}
    for r in got:
        language, posterior, text_language, kept = want[r.doc_id]
        assert (r.language, r.text_language, r.kept) == (language, text_language, kept), r
        assert posterior is None and r.posterior is None or r.posterior == pytest.approx(posterior, rel=1e-6)
