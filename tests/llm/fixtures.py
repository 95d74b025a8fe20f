"""Small tables with nulls, empty and very long texts, ties, repeated rows and
extra columns whose names clash with the operators' own."""

import random

CLASH = ("n_words long, component_id long, keep_id long, text_sha256 string, slot long, cluster long, rep long, "
         "key long, digest string, __x string")
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def edge_texts():
    rng = random.Random(5)
    base = words(rng, 60)
    near = base.split()
    near[30] = "changed"
    long = words(rng, 12_000)
    return [None, "", " ", "\n\t", "one", "One two", "one TWO", base, base.upper(), " ".join(near), base + " tail",
            long, long + " x", "Émile ÉMILE émile", "a b c\x1cd", "ß ẞ İ ﬁ ½ x² 中文 字",
            "<|endoftext|> <| \\| <\\|", *[words(rng, rng.randrange(1, 90)) for _ in range(40)], base, base]


def docs(spark, texts=None):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None) for i, t in enumerate(
        edge_texts() if texts is None else texts)]
    if texts is None:
        rows += [rows[7], rows[7], (None, rows[7][1], "en", "src0"), (None, "only without id", "xx", None)]
    extra = (None,) * len(CLASH.split(","))
    return spark.createDataFrame([(*r, None, *extra) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
