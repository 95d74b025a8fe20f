"""Operators 3, 4, 5, 6, 7, 10 and the pipeline: round trips, brute force, held-out accuracy."""

import base64
import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as fx  # noqa: E402

from prlens.llm import chat, class_lm, feistel, language_id, materialise, packing, sharding, tokens  # noqa: E402
from prlens.llm.catalog import ORACLE, QUERIES  # noqa: E402
from prlens.llm.common import prepare, table  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65_537])
def test_feistel_is_a_permutation(n):
    rows = np.arange(n)
    slots = feistel.permute(rows, n, "k")
    assert sorted(slots.tolist()) == list(range(n))
    assert (feistel.permute(slots, n, "k", back=True) == rows).all()
    if n >= 1000:
        assert (feistel.permute(rows, n, "other") != slots).any()
        assert abs(np.corrcoef(rows, slots)[0, 1]) < 0.1


# ---- tokens


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = tokens.default_path()
    own, lib = tokens.Encoder(path), Tokenizer.from_file(path)
    odd = ["It's we'LL don't 3½ ²x_y \x85a\xa0b", "“q” – café’s €5 ŉ İstanbul ΣΑΣ", "a<|endoftext|>b <|start|>",
           "x\x1cy \x1f z", "中文 字　x", "A​B", "ﬁ ½ １２", "Å Å é", "\x00\x01", "''s 'sss", "👍🏽 ok"]
    for t in [x or "" for x in fx.edge_texts()] + odd:
        assert np.frombuffer(own.encode(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_tokens_of_many_words_equal_the_library():
    """Random words of every length over letters, digits, marks and other scripts, one by one and in texts."""
    from tokenizers import Tokenizer

    rng = random.Random(21)
    path = tokens.default_path()
    own, lib = tokens.Encoder(path), Tokenizer.from_file(path)
    letters = "abcdefghijklmnopqrstuvwxyzeeeeaaattt" * 3 + "0123456789.,-_'!?\"éüñßøłčşāœ€²½" + "中字АБвгΣας"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    words += ["a" * n for n in range(1, 80)] + ["ab" * n for n in range(1, 40)] + ["the" * n for n in range(1, 30)]
    texts = [" ".join(words[i:i + 50]) for i in range(0, len(words), 50)] + words[::7]
    for t, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(t), "<u2").tolist() == want.ids, t


def test_no_count_leaves_a_language_without_a_sample():
    least = -(1 << 63)
    for count in (1, 400, 401, 10**6, 4 * 10**8, 10**12):
        share = (language_id._last_hash(400, count) - least) / 2.0 ** 64
        assert math.isclose(share, min(1, 400 / count), rel_tol=1e-6), count


# ---- 3


def test_training_order_round_trip(spark, tmp_path):
    d = fx.docs(spark)
    folder = tmp_path.as_uri()
    manifest, total = materialise.materialise(d, folder, seq_len=64, shard_records=50)
    assert sum(r.records for r in manifest.collect()) == total
    rows = sorted(materialise.read_shards(spark, folder, 64, 50).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(total))
    assert all(r.byte_offset == r.slot % 50 * materialise.stride(64) and r.shard == r.slot // 50 for r in rows)
    sizes = [os.path.getsize(tmp_path / f"shard-{k:07d}.bin") for k in range(-(-total // 50))]
    assert sizes[:-1] == [50 * materialise.stride(64)] * (len(sizes) - 1)
    assert [f for f in os.listdir(tmp_path) if not f.startswith("shard-")] == []
    enc = tokens.encoder(tokens.default_path())
    want = Counter()
    for r in d.collect():
        ids = enc.encode(r.text or "") + materialise.END_ID.to_bytes(2, "little")
        for k, at in enumerate(range(0, len(ids), 128)):
            want[r.doc_id, k, ids[at:at + 128]] += 1
    assert Counter((r.doc_id, r.seq_no, bytes(r.ids)) for r in rows) == want
    read = list(materialise.read_from(folder, 57, 64, 50))
    assert [x[0] for x in read] == list(range(57, total))
    assert [x[2].tobytes() for x in read] == [bytes(r.ids) for r in rows[57:]]


def test_training_order_of_nothing(spark, tmp_path):
    manifest, total = materialise.materialise(fx.empty(spark), tmp_path.as_uri())
    assert total == 0 and manifest.count() == 0


def test_training_order_rows_follow_the_key(spark):
    rows = QUERIES["op3_training_order"](spark, SF).collect()
    n = len(rows)
    assert (feistel.permute(np.array([r.row for r in rows]), n, materialise.KEY) == [r.slot for r in rows]).all()
    assert sorted(r.row for r in rows) == list(range(n))


# ---- 4


def test_sharding(spark):
    d = fx.docs(spark)
    rows = sharding.shard_documents(d, 7).collect()
    n = d.count()
    assert sorted(r.row for r in rows) == list(range(n))
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(7)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    back = sharding.row_of(np.array([r.shard for r in rows]), np.array([r.slot for r in rows]), n, 7)
    assert back.tolist() == [r.row for r in rows]
    facts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                    for r in d.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == facts
    by_row = sorted(rows, key=lambda r: r.row)
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_row]
    assert ids == sorted(ids)
    again = sharding.shard_documents(d.repartition(5), 7).collect()
    assert {(r.doc_id, r.text_crc32, r.row, r.shard, r.slot) for r in rows} == {
        (r.doc_id, r.text_crc32, r.row, r.shard, r.slot) for r in again}
    assert sharding.shard_documents(fx.empty(spark)).count() == 0


# ---- 5

TRICKY = ["", "<|end|>", "<|", "<\\|", "<\\\\|x", "<<||", "a<", "|>", "<|start|>assistant<|message|>hi<|end|>", "\\",
          "<\\", "\\### Assistant: </turn> ok", "é中\n\t", "<|" * 50, "x" * 3000 + "<|end|>"]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|x", None]), rng.choice([*TRICKY, None]), "extra")
            for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(1, 0, "assistant", "tie", "e"), (1, 0, "assistant", "tie", "e"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, msg string")
    out = chat.render(chat.fold(chat.to_events(df)))
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    masks = {r.conv_id: r for r in out.collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert list(zip(got[c].roles, got[c].texts, strict=True)) == [x[1:] for x in own]
        assert got[c].loss_text == "".join(x[2] for x in own if x[1] == "assistant")
        assert len(masks[c].loss_mask) == len(own)
        assert masks[c].formatted.count(chat.START) == len(own)


def test_chat_folds_edits_and_regenerations(spark):
    e = [(1, 1, 0, "open", "user", None), (1, 1, 1, "delta", None, "Hel"), (1, 1, 3, "delta", None, "!"),
         (1, 1, 2, "delta", None, "lo"), (1, 1, 2, "delta", None, "lo"),
         (1, 2, 0, "open", "assistant", None), (1, 2, 1, "delta", None, "wrong"), (1, 2, 2, "regenerate", None, None),
         (1, 2, 3, "delta", None, "ri"), (1, 2, 4, "delta", None, "ght"),
         (1, 3, 0, "open", "user", None), (1, 3, 1, "delta", None, "draft"), (1, 3, 2, "edit", None, "final"),
         (1, 3, 3, "delta", None, " text"), (2, 1, 0, "open", None, None)]
    df = spark.createDataFrame(e, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = sorted(map(tuple, chat.fold(df.repartition(4)).collect()))
    assert got == [(1, 1, "user", "Hello!"), (1, 2, "assistant", "right"), (1, 3, "user", "final text"), (2, 1, "", "")]
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_chat_plan_is_native(spark):
    plan = QUERIES["op5_chat"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# ---- 6


def check_packing(rows, docs, capacity=4096):
    enc = tokens.encoder(tokens.default_path())
    want = Counter()
    for i, t in docs:
        ids = np.frombuffer(enc.encode(t or "") + (2).to_bytes(2, "little"), "<u2")
        for at in range(0, len(ids), capacity):
            want[i, at, ids[at:at + capacity].tobytes(), len(ids)] += 1
    assert Counter((r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(r.length for r in rows) / capacity / max(1, len(sequences))


def test_packing_edges(spark):
    d = fx.docs(spark)
    check_packing(packing.pack(d).collect(), [(r.doc_id, r.text) for r in d.collect()])
    assert packing.pack(fx.empty(spark)).count() == 0


def test_packing_fills_sequences(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    assert check_packing(packing.pack(d).collect(), [(r.doc_id, r.text) for r in d.collect()]) > 0.97


@pytest.mark.parametrize("seed", range(4))
def test_cutting_stock_meets_demand(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 257), 40, replace=False))
    demand = rng.integers(0, 500, 40) + 1
    patterns, number = packing.solve(sizes, demand, 256)
    assert (number @ patterns == demand).all() and ((patterns @ sizes) <= 256).all()
    assert number.sum() <= demand @ sizes / 256 * 1.02 + 20 or (sizes > 128).mean() > 0.4


# ---- 7


def test_class_model_counts_and_base(spark):
    d = fx.docs(spark)
    rows = d.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    toks = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for r in rows if not held(r.doc_id) for w in toks(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted(((r.doc_id, held(r.doc_id), len(t := toks(r.text)), sum(c[w] > 0 for w in t), n, round(sum(
        math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)) for r in rows), key=repr)
    got = class_lm.score_documents(d).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
                   for r in got), key=repr) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert class_lm.score_documents(fx.empty(spark)).count() == 0


def test_class_model_against_its_formula(spark):
    """Scores from the clustering's own numbers, token by token."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 12)))
             for _ in range(80)] + ["zz yy a"]
    rows = list(enumerate(texts))
    toks = [t.encode().split() + [b""] for t in texts]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in toks[i])
    top = [b""] + [w for w, _ in sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0]))]
    unit = {w: k for k, w in enumerate(top)}
    low, n = class_lm.TOP_WORDS + 1, class_lm.TOP_WORDS + 1 + class_lm.BANDS
    grid = np.zeros((n, n))
    for i in train:
        seq = [0] + [unit[w] for w in toks[i]]
        for a, b in zip(seq, seq[1:], strict=False):
            grid[a, b] += 1
    cls = class_lm.exchange(grid)
    of = lambda w: int(cls[unit.get(w, low)])
    moves, tokens_, types = Counter(), Counter(), Counter({int(cls[low]): 1})
    for a, b in zip(*np.nonzero(grid), strict=True):
        moves[int(cls[a]), int(cls[b])] += grid[a, b]
    for w, k in c.items():
        tokens_[of(w)] += k
        types[of(w)] += 1
    out = Counter()
    for (a, _), k in moves.items():
        out[a] += k

    def logp(a, w):
        b = of(w)
        return math.log10((moves[a, b] + 0.1) / (out[a] + 0.1 * class_lm.CLASSES)
                          * (c[w] + 0.1) / (tokens_[b] + 0.1 * types[b]))

    want = {i: sum(logp(of(t[k - 1]) if k else of(b""), w) for k, w in enumerate(t)) for i, t in enumerate(toks)}
    got = class_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-9) for r in got)
    for a in range(class_lm.CLASSES):  # all words, and one unseen word, after any class
        full = sum(10 ** logp(a, w) for w in [*c, b"unseen"])
        rest = sum((moves[a, b] + 0.1) / (out[a] + 0.1 * class_lm.CLASSES)
                   for b in range(class_lm.CLASSES) if not types[b])
        assert math.isclose(full + rest, 1, rel_tol=1e-9)


def test_class_model_beats_the_base_on_held_out_text(spark):
    rows = class_lm.score_documents(table(spark, "/root/testdata/sf0.01", "documents")).collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(0)
    true = np.array([0] + [1 + i % 3 for i in range(30)])
    move = np.array([[0, .5, .3, .2], [.1, .05, .8, .05], [.1, .05, .05, .8], [.1, .8, .05, .05]])
    grid, c = np.zeros((31, 31)), 0
    prev = 0
    for _ in range(40_000):
        c = rng.choice(4, p=move[true[prev]])
        cur = 0 if c == 0 else rng.choice(np.flatnonzero(true == c))
        grid[prev, cur] += 1
        prev = cur
    cls = class_lm.exchange(grid, classes=4, sweeps=20)
    assert len({(a, b) for a, b in zip(true.tolist(), cls.tolist(), strict=True)}) == 4


def test_class_model_places_rare_words_by_their_neighbours(spark):
    """Two kinds of words alternate; most words are rarer than the TOP_WORDS most frequent."""
    rng = random.Random(7)
    pick = lambda kind: f"{kind}{rng.randrange(300) if rng.random() < 0.6 else rng.randrange(300, 900)}"
    rows = [(i, " ".join(pick("ab"[k % 2]) for k in range(40))) for i in range(3000)]
    mixed = [i for i in range(5000, 5400) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    for i in mixed:
        a, b = (rng.sample([f"{kind}{k}" for k in range(300, 900)], 20) for kind in "ab")
        rows += [(i, " ".join(x for p in zip(a, b, strict=True) for x in p)), (i + 100_000, " ".join(a + b))]
    keep = {i + 100_000: i for i in mixed}
    got = {r.doc_id: r for r in class_lm.score_documents(spark.createDataFrame(
        [r for r in rows], "doc_id long, text string")).collect()}
    assert all(got[i].score > got[j].score + 5 for j, i in keep.items())


def test_gains_equal_the_likelihood_of_each_move():
    rng = np.random.default_rng(3)
    n, k = 40, 6
    grid = rng.integers(0, 9, (n, n)) * (rng.random((n, n)) < 0.4)
    cls = rng.integers(1, k, n)
    cls[0] = 0
    member = np.eye(k)[cls]
    full = member.T @ grid @ member
    own = np.diag(grid).astype(float)
    into, out = grid.T @ member, grid @ member
    into[np.arange(n), cls] -= own
    out[np.arange(n), cls] -= own
    gain = class_lm.gains(full, cls, into, out, own)
    for u in range(1, n):
        for b in range(1, k):
            other = cls.copy()
            other[u] = b
            m = np.eye(k)[other]
            want = class_lm.likelihood(m.T @ grid @ m) - class_lm.likelihood(full)
            assert math.isclose(gain[u, b] - gain[u, cls[u]], want, rel_tol=1e-9, abs_tol=1e-7)


# ---- 10


def test_language_held_out_accuracy(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(language_id.labelled(d.filter("doc_id % 2 = 0")))
    rows = language_id.document_rows(d.filter("doc_id % 2 = 1"))
    blind = language_id.identify(rows.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS declared",
                                                 "CAST(NULL AS STRING) AS host"), model)
    pair = blind.join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in pair) / len(pair) > 0.95
    full = language_id.identify(rows, model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in full) / len(full) > 0.99
    assert all(r.kept for r in full)


def test_language_pages(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    p = language_id.page_rows(table(spark, "/root/testdata/sf0.01", "pages"))
    got = language_id.identify(p, language_id.fit(language_id.labelled(d))).collect()
    assert sum(r.language == r.declared for r in got) / len(got) > 0.95


def test_language_evidence_breaks_ties(spark):
    """A text that fits two languages alike follows the declaration, then the host."""
    model = language_id.fit(spark.createDataFrame(
        [(i, "le la le la" if i % 2 else "the of the of", "fr" if i % 2 else "en") for i in range(80)],
        "doc_id long, text string, lang string"))
    rows = [(i, "the of the of" if i % 2 else "le la le la", "en" if i % 2 else "fr",
             "a.site.uk" if i % 2 else "b.site.fr") for i in range(60)]
    rows += [(100, "zzz", "en", "x.y"), (101, "zzz", "fr", "x.y"), (102, "zzz", None, "a.site.uk"),
             (103, "zzz", None, "b.site.fr"), (104, "zzz", None, "new.site.fr")]
    got = {r.doc_id: r.language for r in language_id.identify(spark.createDataFrame(
        rows, "doc_id long, text string, declared string, host string"), model).collect()}
    assert [got[i] for i in range(100, 104)] == ["en", "fr", "en", "fr"]


def test_language_edges(spark):
    d = fx.docs(spark)
    rows = language_id.identify(language_id.document_rows(d), language_id.fit(language_id.labelled(d))).collect()
    assert len(rows) == d.count()
    assert all(not r.kept and r.language is None for r in rows if r.doc_id in (0, 1, 2, 3))
    assert language_id.keep_languages(d).columns == d.columns
    assert language_id.keep_languages(fx.empty(spark)).count() == 0
    none = language_id.identify(language_id.document_rows(d), ([], np.zeros((language_id.BUCKETS, 0))))
    assert none.filter("kept").count() == 0


def test_language_models_every_label(spark):
    """More than fifty languages, some only under regional labels."""
    rng = random.Random(9)
    names = [f"{a}{b}" for a in "abcdefgh" for b in "qrstuvwx"]
    stock = {x: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(6)] for x in names}
    text = lambda x: " ".join(rng.choice(stock[x]) for _ in range(30))
    rows = [(64 * k + i, text(x), f"{x}-{'US' if k % 2 else 'gb'}") for k in range(4) for i, x in enumerate(names)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model[0] == sorted(names)
    new = [(i, text(x), f"{x}-ZZ", "h") for i, x in enumerate(names)]
    got = language_id.identify(spark.createDataFrame(new, "doc_id long, text string, declared string, host string"),
                               model).collect()
    assert {r.doc_id: (r.language, r.declared, r.kept) for r in got} == {
        i: (x, x, True) for i, x in enumerate(names)}


def test_language_rejects_unknown_languages_and_junk(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(language_id.labelled(d.filter("lang != 'es'")))
    rng = random.Random(4)
    junk = [base64.b64encode(rng.randbytes(400)).decode() for _ in range(10)] + ["=+*/ #x1 &&|| ()[]{} <>;: " * 20]
    rows = [(r.text, True) for r in d.filter("lang = 'es' AND length(text) > 100").collect()] + [(x, False) for x in junk]
    bad = spark.createDataFrame([(i, x, "en", "h") for i, (x, _) in enumerate(rows)],
                                "doc_id long, text string, declared string, host string")
    assert not any(r.kept for r in language_id.identify(bad, model).collect())


# ---- queries and the pipeline


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    from prlens.plans.oracle import compare, duck_connection

    ok, msg = compare(QUERIES[name](spark, SF), duck_connection(SF), ORACLE[name])
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_chat_query_digests(spark):
    trap = next(r for r in QUERIES["op5_chat"](spark, SF).collect() if r.conv_id == -7)
    text = chat.TRAP
    assert (trap.n_turns, trap.loss_chars) == (2, len(text))
    assert trap.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert trap.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from test_text_operators import leak_truth, lower, near_truth

    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    last = {}
    for i, t in docs:
        last[lower(t)] = max(i, last.get(lower(t), i))
    kept = [(i, t) for i, t in docs if last[lower(t)] == i]
    near = {i for i, _, _, keep in near_truth(kept, 5, 80, 100) if keep}
    kept = [(i, t) for i, t in kept if i in near]
    leaks = {r[0] for r in leak_truth(kept, items) if r[5]}
    got = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {i for i, _ in kept} - leaks
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    d = fx.docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, SF).columns == d.columns
        assert stage(spark, fx.empty(spark), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() >= d.count()
