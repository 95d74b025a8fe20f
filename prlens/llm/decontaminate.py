"""Operator 2: benchmark decontamination with one Aho-Corasick automaton.

Words are lower-cased runs (``words.ALNUM``).  A window is any ten consecutive
words of a benchmark item; an item with fewer words is one window.  The
automaton holds, as text between single spaces, the item's words in aligned
blocks of five (a short item whole): any ten words in a row contain one such
block, so each text is scanned once and every block found is extended to both
sides against the item.  A run of ten or more equal words is exactly a union of
windows.  Positions map back to the original text: normalising keeps the length
in bytes, and word numbers give the offsets.

The items travel to the executors as one broadcast only up to
``AUTOMATON_BYTES`` of normalised text; a larger benchmark is split into
several automata, each with a scan of its own, and their hits are merged row by
row.

Defined results: a null or empty text has no words and no hits; a null item
text has no window; items that repeat an item_id count once under it; an item
without id counts under the id ``null``; other columns are ignored; an empty
benchmark marks nothing.
"""

from __future__ import annotations

import pickle

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prlens.llm.common import documents, map_batches, stored, table, text_hash, without
from prlens.llm.registry import register
from prlens.llm.words import alnum_bytes, char_offsets, word_spans

WINDOW, BLOCK = 10, 5

#: Normalised benchmark bytes in one automaton (about 60 bytes of memory each).
AUTOMATON_BYTES = 4 << 20

HITS = "_hits array<struct<first:long,last:long,start:long,end:long,item:string>>, n_words long"

_CACHE: dict[object, tuple] = {}


def _automaton(key, items: list[tuple[str, list[bytes]]]):
    """(automaton over blocks, {pattern: [(item, first word of the block)]}); kept for a worker's later tasks."""
    if key not in _CACHE:
        _CACHE.clear()
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, words) in enumerate(items):
            step = BLOCK if len(words) >= WINDOW else len(words)
            for at in range(0, len(words) - step + 1, step):
                pattern = (b" " + b" ".join(words[at:at + step]) + b" ").decode("latin-1")
                places.setdefault(pattern, []).append((i, at))
        machine = ahocorasick.Automaton()
        for pattern in places:
            machine.add_word(pattern, pattern)
        if places:
            machine.make_automaton()
        _CACHE[key] = machine, places
    return _CACHE[key]


def find_runs(norm: bytes, machine, places, items) -> tuple[int, list[tuple[int, int, int]]]:
    """(number of words, [(first word, last word, item)]) of a normalised text."""
    words = norm.split()
    if not words or not places:
        return len(words), []
    flat = b" " + b" ".join(words) + b" "
    starts = None
    runs, done = [], {}
    for end, pattern in machine.iter(flat.decode("latin-1")):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        d = int(np.searchsorted(starts, end - len(pattern) + 1))
        for i, at in places[pattern]:
            if done.get((i, d - at), -1) >= d:
                continue
            item = items[i][1]
            n = min(len(item), WINDOW)
            a, b = d, d + min(BLOCK, n)
            while a and at - (d - a) and words[a - 1] == item[at - (d - a) - 1]:
                a -= 1
            while b < len(words) and at + (b - d) < len(item) and words[b] == item[at + (b - d)]:
                b += 1
            if len(item) < WINDOW:
                a, b = d, d + len(item)
            done[(i, d - at)] = b - 1
            if b - a >= n:
                runs.append((a, b - 1, i))
    return len(words), runs


_KIND = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()),
                            ("end", pa.int64()), ("item", pa.string())]))


def _scan(shared, key, first: bool, last: bool):
    """Batches with the hits of this automaton; the text stays if more follow."""
    def run(batches):
        items = shared.value
        machine, places = _automaton(key, items)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            hits = [[] for _ in texts] if first else batch.column("_hits").to_pylist()
            n_words = []
            for text, found in zip(texts, hits, strict=True):
                norm = alnum_bytes(text)
                n, runs = find_runs(norm, machine, places, items)
                n_words.append(n)
                if runs:
                    begin, end = word_spans(norm)
                    a = char_offsets(text, begin[[r[0] for r in runs]])
                    b = char_offsets(text, end[[r[1] for r in runs]])
                    found += [{"first": r[0], "last": r[1], "start": int(x), "end": int(y), "item": items[r[2]][0]}
                              for r, x, y in zip(runs, a, b, strict=True)]
            cols = {c: batch.column(c) for c in ("doc_id", "text_hash", *(() if last else ("text",)))}
            yield pa.RecordBatch.from_pydict(cols | {"_hits": pa.array(hits, _KIND),
                                                     "n_words": pa.array(n_words, pa.int64())})
    return run


def _parts(benchmark: DataFrame):
    """The items as lists of at most AUTOMATON_BYTES normalised bytes."""
    part, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string"))
    for item_id, text in rows.toLocalIterator():
        words = alnum_bytes(text).split()
        own = sum(map(len, words)) + len(words)
        if part and size + own > AUTOMATON_BYTES:
            yield part
            part, size = [], 0
        if words:
            part.append((item_id, words))
            size += own
    yield part


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, spans (first and last word, start
    and end character, item of every run found)."""
    spark, rows = docs.sparkSession, documents(docs, text_hash(docs).alias("text_hash"))
    parts = _parts(benchmark)
    part, k = next(parts), 0
    while part is not None:
        after = next(parts, None)
        scan = _scan(spark.sparkContext.broadcast(part), hash(pickle.dumps(part)), k == 0, after is None)
        rows = map_batches(rows, scan, "doc_id long, text_hash long, " + ("" if after is None else "text string, ") + HITS)
        if after is not None:
            rows = stored(rows, f"leaks-{k}")
        part, k = after, k + 1
    return rows.select("doc_id", "text_hash", "n_words", F.col("_hits").alias("spans"))


def _n_hit(spans):
    """Words inside any span: sorted spans, counted past what earlier ones cover."""
    ordered = F.array_sort(spans)
    step = F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(acc["upto"], s["first"] - 1))).alias("n"),
            F.greatest(acc["upto"], s["last"]).alias("upto")))
    return step["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted), contaminated, spans."""
    leaks = find_leaks(docs, benchmark)
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    return (leaks.withColumn("item_ids", ids).withColumn("n_hit", _n_hit(F.col("spans")))
            .select("doc_id", "text_hash", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
                    (F.col("n_hit") > 0).alias("contaminated"), "spans"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with all their columns."""
    lost = decontaminate(docs, benchmark).filter("contaminated").select("doc_id", "text_hash")
    return without(docs, stored(lost, "contaminated"))


def _words_sql(col: str) -> str:
    lowered = f"translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@register("op2_decontaminate", f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
i AS MATERIALIZED (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_words_sql('text')} AS w FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0) t),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM win) l WHERE len(w) >= n) t),
hit AS MATERIALIZED (SELECT doc_id, p, n, item FROM dw JOIN win USING (n, k)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) t GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids
       FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)""")
def q_decontaminate(spark, sf_dir):
    """Operator 2: all documents against all benchmark items."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
