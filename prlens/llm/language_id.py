"""Operator 10: language identification by Bayesian evidence fusion.

Rows carry a text, a declared language (markup or column), and a host.  Four
pieces of evidence meet in one posterior for each row:

- text: naive Bayes over hashed byte trigrams of the lower-cased text, with the
  exponent TEMPER, since neighbouring trigrams overlap;
- declaration: P(declared | language), counted over all rows by a grouped
  aggregation of (declared, language the text alone suggests), smoothed;
- address: prior of the host, smoothed towards its domain, that towards its
  address suffix, that towards all rows.  The counts are grouped aggregations
  with map-side combination, so a host with a third of the rows is one sum.

Only the trigram model is fitted on a sample: rows chosen by a hash of doc_id,
SAMPLE_ROWS for each language in expectation (all of them where there are
fewer); its trigrams are a grouped sum.  Every labelled language has a model, kept
as its seen buckets only.  Every other count covers all rows.  Labels and
declarations are cut to the letters they begin with (en-us is en).

A row is kept when its text has a letter trigram, the posterior of the best language is
MIN_POSTERIOR or more, that language is wanted (default: any known one), and the text
looks like it at all: its mean log-likelihood for each trigram reaches the language's
floor.  The floor lies FLOOR_SDS deviations below the mean of the sampled texts, each
scored without its own counts, so that texts in unknown languages and junk go.
A text of few trigrams is given FLOOR_SDS deviations of its own shorter mean.

Defined results: null or empty texts, or an input without any labelled row, get
no language and are not kept; null hosts share the empty host; null or unknown
declarations have classes of their own; repeated rows each get a result; ties
go to the language that comes first by name; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prlens.llm.common import map_batches, stored, table, text_hash, without
from prlens.llm.registry import register
from prlens.llm.words import alnum_bytes

SAMPLE_ROWS = 400
BUCKETS = 1 << 16
TEMPER = 0.3
MIN_POSTERIOR = 0.5
FLOOR_SDS = 8.0
#: Weight of the wider prior, in rows.
PRIOR_ROWS = 5.0


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of a text (lower case, punctuation as spaces, runs of spaces as one)."""
    words = alnum_bytes(text).split()
    if not words:
        return np.zeros(0, np.int64)
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    h = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64)


def main_code(c: Column) -> Column:
    """The letters a language code begins with, in lower case; empty without any."""
    return F.lower(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), "^[A-Za-z]+", 0))


class Trigrams:
    """log P(bucket | language), stored by bucket for the languages that have seen it."""

    def __init__(self, lang: np.ndarray, bucket: np.ndarray, n: np.ndarray, languages: int):
        order = np.argsort(bucket, kind="stable")
        self.lang, self.n, self.languages = lang[order].astype(np.int32), n[order].astype(np.float64), languages
        self.at = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))])
        self.total = np.bincount(lang, weights=n, minlength=languages) + 0.5 * BUCKETS
        self.floors, self.spreads = np.full(languages, -np.inf), np.zeros(languages)
        self.over = np.log(self.n + 0.5) - np.log(0.5)

    def cells(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``buckets``, entry) of each entry of these buckets."""
        lo, size = self.at[buckets], self.at[buckets + 1] - self.at[buckets]
        place = np.repeat(np.arange(len(buckets)), size)
        return place, np.arange(len(place)) + np.repeat(lo - np.cumsum(size) + size, size)

    def alone(self, got: np.ndarray, lang: int) -> tuple[float, float]:
        """(sum, sum of squares) of the log-probabilities of a sampled text's trigrams under its own language,
        the text's counts taken out."""
        buckets, times = np.unique(got, return_counts=True)
        place, entry = self.cells(buckets)
        own = self.lang[entry] == lang
        left = np.zeros(len(buckets))
        left[place[own]] = self.n[entry[own]]
        logs = np.log(left - times + 0.5) - np.log(self.total[lang] - len(got))
        return float(logs @ times), float(logs ** 2 @ times)

    def score(self, got: np.ndarray) -> np.ndarray:
        """Log-likelihood of trigrams under each language."""
        buckets, times = np.unique(got, return_counts=True)
        place, entry = self.cells(buckets)
        return (np.bincount(self.lang[entry], weights=self.over[entry] * times[place], minlength=self.languages)
                + len(got) * (np.log(0.5) - np.log(self.total)))


def _alone(model, at: dict[str, int]):
    def run(batches):
        for batch in batches:
            out = {"lang": [], "n": [], "mean": [], "square": []}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                got = trigrams(text.as_py())
                if len(got):
                    total, square = model.value.alone(got, at[lang])
                    for k, v in zip(out, (lang, len(got), total / len(got), square / len(got)), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["n"], pa.int64()),
                                              pa.array(out["mean"], pa.float64()), pa.array(out["square"], pa.float64())],
                                             list(out))
    return run


def _trigram_counts(batches):
    for batch in batches:
        found: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            found.setdefault(lang, []).append(trigrams(text.as_py()))
        for lang, parts in found.items():
            buckets, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n), pa.string()),
                                              "bucket": pa.array(buckets, pa.int64()), "n": pa.array(n, pa.int64())})


def _last_hash(rows: int, count: int) -> int:
    """The long up to which 64-bit hashes choose about ``rows`` of ``count`` rows."""
    return min((1 << 63) - 1, (1 << 64) * rows // count - (1 << 63))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], Trigrams]:
    """(languages, trigram model) from rows (doc_id, text, lang)."""
    rows = labelled.filter(F.col("text").isNotNull()).withColumn("lang", main_code(F.col("lang"))).filter("lang != ''")
    sizes = rows.groupBy("lang").count().collect()
    names = sorted(r["lang"] for r in sizes)
    at = {name: i for i, name in enumerate(names)}
    cuts = labelled.sparkSession.createDataFrame(
        [(r["lang"], _last_hash(sample_rows, r["count"])) for r in sizes], "lang string, cut long")
    # The whole hash decides, so that no number of rows leaves a language without a sample; rows with the
    # same or no id are told apart by their texts.
    sample = (rows.join(F.broadcast(cuts), "lang").filter(F.xxhash64("doc_id", "text") <= F.col("cut"))
              .select("lang", "text"))
    seen = (map_batches(sample, _trigram_counts, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    model = Trigrams(seen["lang"].map(at).to_numpy(np.int64), seen["bucket"].to_numpy(np.int64),
                     seen["n"].to_numpy(np.int64), len(names))
    alone = map_batches(sample, _alone(labelled.sparkSession.sparkContext.broadcast(model), at),
                        "lang string, n long, mean double, square double")
    for r in alone.groupBy("lang").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("sd"),
                                       F.avg(F.col("square") - F.col("mean") ** 2).alias("inner")).collect():
        model.floors[at[r["lang"]]] = r["mean"] - FLOOR_SDS * r["sd"]
        model.spreads[at[r["lang"]]] = FLOOR_SDS * max(r["inner"], 0.0) ** 0.5
    return names, model


def _likelihoods(model):
    def run(batches):
        logs = model.value
        for batch in batches:
            out, seen = np.zeros((batch.num_rows, logs.languages), np.float64), []
            for k, text in enumerate(batch.column("text")):
                got = trigrams(text.as_py())
                seen.append(len(got))
                out[k] = logs.score(got)
            keys = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in keys} | {
                "n_trigrams": pa.array(seen, pa.int64()), "loglik": pa.array(list(out), pa.list_(pa.float64()))})
    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda s, y: s + y))


def _shares(counts: Column, wider: Column) -> Column:
    """Counts smoothed towards a wider distribution, as shares."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(counts, wider, lambda c, p: (c + PRIOR_ROWS * p) / (total + PRIOR_ROWS))


def host_priors(votes: DataFrame, names: list[str]) -> DataFrame:
    """(host, prior) for each host: host towards domain, domain towards suffix,
    suffix towards all.  votes: (host, vote)."""
    n = len(names)
    sums = lambda: [F.sum(f"c{i}").alias(f"c{i}") for i in range(n)]
    vector = F.array(*[F.col(f"c{i}").cast("double") for i in range(n)])
    parts = F.split("host", r"\.")
    hosts = (votes.groupBy("host").agg(*[F.sum((F.col("vote") == i).cast("long")).alias(f"c{i}") for i in range(n)])
             .withColumn("suffix", F.element_at(parts, -1))
             .withColumn("domain", F.array_join(F.slice(parts, -2, 2), ".") if n else F.lit("")))
    hosts = hosts.withColumn("domain", F.when(F.size(parts) < 2, F.col("host")).otherwise(F.col("domain")))
    domains = hosts.groupBy("suffix", "domain").agg(*sums())
    suffixes = domains.groupBy("suffix").agg(*sums())
    whole = suffixes.agg(*sums()).first()
    total = sum(x or 0 for x in whole) + n
    over_all = F.array(*[F.lit(((x or 0) + 1) / total) for x in whole])
    suffixes = suffixes.select("suffix", _shares(vector, over_all).alias("p_suffix"))
    domains = (domains.join(suffixes, "suffix")
               .select("suffix", "domain", _shares(vector, F.col("p_suffix")).alias("p_domain")))
    return hosts.join(domains, ["suffix", "domain"]).select("host", _shares(vector, F.col("p_domain")).alias("prior"))


def identify(rows: DataFrame, model: tuple[list[str], Trigrams], wanted: list[str] | None = None) -> DataFrame:
    """rows: any key columns, then text, declared, host.  Adds to the keys:
    language, posterior, text_language, declared, host, kept."""
    names, logs = model
    spark = rows.sparkSession
    keys = [c for c in rows.columns if c not in ("text", "declared", "host")]
    none = [F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"),
            F.lit(None).cast("string").alias("text_language"), "declared", "host", F.lit(False).alias("kept")]
    if not names:
        return rows.select(*keys, *none)
    shared = spark.sparkContext.broadcast(logs)
    code = main_code(F.col("declared"))
    slim = rows.select(*keys, F.col("text").cast("string").alias("text"),
                       F.when(code == "", "none").when(code.isin(names), code).otherwise("other").alias("declared"),
                       F.lower(F.coalesce(F.col("host"), F.lit(""))).alias("host"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    scored = map_batches(slim, _likelihoods(shared), f"{fields}, n_trigrams long, loglik array<double>")
    scored = stored(scored.withColumn("loglik", F.transform("loglik", lambda x: x * TEMPER))
                    .withColumn("vote", F.array_position("loglik", F.array_max("loglik")).cast("int") - 1), "language")
    seen = scored.filter("n_trigrams > 0")
    pairs = {(r[0], r[1]): r[2] for r in seen.groupBy("declared", "vote").count().collect()}
    kinds = [*names, "other", "none"]
    rows_of = [sum(pairs.get((k, i), 0) for k in kinds) for i in range(len(names))]
    declared = F.broadcast(spark.createDataFrame([(k, [
        float(np.log((pairs.get((k, i), 0) + 1) / (rows_of[i] + len(kinds)))) for i in range(len(names))]) for k in kinds],
        "declared2 string, declared_logs array<double>"))
    # Written, so that both sides of the join are plain exchanges and a hot host's rows can be split.
    priors = stored(host_priors(seen.select("host", "vote"), names).withColumnRenamed("host", "host2"), "priors")
    flat = F.array(*[F.lit(1.0 / len(names))] * len(names))
    fused = (scored.join(priors, scored.host == priors.host2, "left")
             .join(declared, F.col("declared") == F.col("declared2"))
             .withColumn("prior", F.coalesce("prior", flat))
             .withColumn("logs", F.zip_with(F.zip_with("loglik", F.transform("prior", lambda p: F.log(p)),
                                                       lambda a, b: a + b), F.col("declared_logs"),
                                            lambda a, b: a + b))
             .withColumn("posteriors", _softmax(F.col("logs"))))
    name = F.array(*[F.lit(x) for x in names])
    best = F.array_max("posteriors")
    # The text's own log-likelihood in the picked language, against what its length lets it miss the floor by.
    at = F.array_position("posteriors", best).cast("int") - 1
    floors, spreads = (F.array(*[F.lit(float(x)) for x in v]) for v in (logs.floors, logs.spreads))
    like = (F.get("loglik", at) / TEMPER / F.nullif(F.col("n_trigrams"), F.lit(0))
            >= F.get(floors, at) - F.get(spreads, at) / F.sqrt(F.nullif(F.col("n_trigrams"), F.lit(0))))
    found = F.col("n_trigrams") > 0
    pick = F.when(found, F.get(name, F.array_position("posteriors", best).cast("int") - 1))
    out = fused.select(*keys, pick.alias("language"), F.when(found, best).alias("posterior"),
                       F.when(found, F.get(name, F.col("vote"))).alias("text_language"), "declared", "host",
                       like.alias("__like"))
    ok = F.col("__like") & (F.col("posterior") >= MIN_POSTERIOR) & F.col("language").isin(wanted if wanted is not None else names)
    return out.withColumn("kept", F.coalesce(ok, F.lit(False))).drop("__like")


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence rows: the lang column is the declaration, the source the host."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_hash(docs).alias("text_hash"), F.col("lang").cast("string").alias("declared"),
                       F.col("source").cast("string").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Web pages as evidence rows: <html lang>, host of the address, visible text outside navigation."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|aside|footer)\b.*?</\1\s*>|<!--.*?-->", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(bare, r"(?s)<[^>]*>|&\w+;", " ").alias("text"),
        F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", 1).alias("declared"),
        F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\w+://(?:[^/@]*@)?([^/:?#]+)", 1)
        .alias("host"))


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       main_code(F.col("lang").cast("string")).alias("lang"))


def keep_languages(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The documents whose language is identified (and wanted), with all their columns."""
    found = identify(document_rows(docs), fit(labelled(docs)), wanted)
    return without(docs, found.filter(~F.col("kept")))


@register("op10_language_id")
def q_language_id(spark, sf_dir):
    """Operator 10 over all documents and all pages (a row for each of either)."""
    docs = table(spark, sf_dir, "documents")
    rows = (document_rows(docs).drop("text_hash").withColumn("page_id", F.lit(None).cast("long"))
            .unionByName(page_rows(table(spark, sf_dir, "pages")).withColumn("doc_id", F.lit(None).cast("long"))))
    return identify(rows, fit(labelled(docs))).select(
        "doc_id", "page_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "declared",
        "host", "kept")
