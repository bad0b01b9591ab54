"""Language identification by Bayesian fusion of text, declared language, address and host.

Byte-trigram models of each language are counted over a bounded sample of the rows of each label.
A row's text likelihood (tempered, since trigrams overlap) is combined with its declared
language and with a prior of its host.  Host priors are soft counts of the rows' text and
declared evidence, summed by host, domain and address suffix and smoothed from the global
shares down; a row's own counts are taken out of its host's.

Edge cases: a null or letterless text gives no text evidence; a null or unknown declared
language, host or suffix gives none of its kind; with no evidence at all the language is
the most common one at its prior; repeated rows are judged alike; a row whose declared
language has no model is rejected only without letters; of more labels than MAX_LANGUAGES the
most frequent have models; an empty table gives no rows; without labelled rows there are no
languages and every result is null.  `accept` returns the columns of its input as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_names, small_side, let

#: Bounds of the training sample of each language and of the languages modelled.
SAMPLE, MAX_LANGUAGES = 1000, 200
BINS = 1 << 15
#: Weight of a trigram's log-likelihood; trust in a declared language; strength of each prior level.
TEMPER, DECLARED_ERROR, STRENGTH = 0.25, 0.1, 5.0
#: Mean log-likelihood of a trigram below which a text is no known language (uniform bins: -10.4).
FLOOR = -10.0
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigram_bins(text: bytes) -> np.ndarray:
    """Bins of the lower-cased byte trigrams, other characters folded into single spaces; none without letters."""
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8)
    letter = _LETTER[b]
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter | np.concatenate(([True], letter[:-1]))
    x = np.where(letter, b, 32)[keep].astype(np.int64)
    h = (x[:-2] * 65536 + x[1:-1] * 256 + x[2:]) * 0x9E3779B1
    return (h >> 13) % BINS


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (bins, languages)


def train(docs: DataFrame, rows: int = SAMPLE) -> Model:
    """Trigram models from at most `rows` distinct texts of each label (text, lang), those of least hash; copies count.

    A share of the hash range that holds about 2 * `rows` distinct texts of the label is filtered in the scan, so that
    the ordered limit gets a bounded number of texts at every size of the table, and a rare label all of its texts.
    """
    known = docs.where("lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null")
    known = known.withColumn("h", F.xxhash64("text", "lang"))
    top = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in top)
    if not languages:
        return Model([], np.zeros((BINS, 0), np.float32))
    upto = [(r["lang"], min((1 << 63) - 1, int(min(1.0, 2 * rows / max(1, r["texts"])) * 2**64) - (1 << 63))) for r in top]
    bounds = docs.sparkSession.createDataFrame(upto, "lang string, upto long")
    known = known.join(F.broadcast(bounds), "lang").where("h <= upto")
    once = known.groupBy("h").agg(F.first("text").alias("text"), F.first("lang").alias("lang"), F.count("*").alias("copies"))
    ranked = once.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    picked = cut(ranked.where(F.col("at") <= rows).select("text", "lang", "copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {}
        for b in batches:
            for text, lang, copies in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts[lang] = counts.get(lang, 0) + copies * np.bincount(trigram_bins(text), minlength=BINS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "bin", "n"])

    counts = picked.mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = np.full((BINS, len(languages)), 0.1)
    place = {x: i for i, x in enumerate(languages)}
    got = counts.toArrow()  # at most BINS rows a language
    table[got["bin"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def text_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """Replaces column text of `rows(key, text, declared, host, domain, suffix)` by n (trigrams) and mean, the mean
    log-likelihoods by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, mean = [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                bins = trigram_bins(t or b"")
                n.append(len(bins))
                mean.append((model.logp[bins].sum(0, dtype=np.float64) / max(1, len(bins))).tolist())
            cols = [b.column(c) for c in ("key", "declared", "host", "domain", "suffix")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(mean, pa.list_(pa.float64()))], names=["key", "declared", "host", "domain", "suffix", "n", "mean"])

    return rows.select("key", "text", "declared", "host", "domain", "suffix").mapInArrow(run, "key long, declared string, host string, domain string, suffix string, n long, mean array<double>")


def _softmax(logs: Column) -> Column:
    divided = lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))
    return let(logs, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), divided)))


def fuse(evidence: DataFrame, model: Model, strength: float = STRENGTH) -> DataFrame:
    """`evidence` with lang, confidence, text_lang and mean_loglik: the most probable language given all evidence."""
    k = len(model.languages)
    if not k:
        return evidence.select("key", "declared", "host", "n", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("double").alias("mean_loglik"))
    langs = F.array(*map(F.lit, model.languages))
    steps = F.col("n") * F.lit(TEMPER)
    text = F.when(F.col("n") > 0, F.transform("mean", lambda x: x * steps)).otherwise(F.array_repeat(F.lit(0.0), k))
    said = F.when(
        F.array_contains(langs, F.col("declared")), F.transform(langs, lambda x: F.when(x == F.col("declared"), F.log(F.lit(1 - DECLARED_ERROR))).otherwise(F.log(F.lit(DECLARED_ERROR / max(1, k - 1)))))
    ).otherwise(F.array_repeat(F.lit(0.0), k))
    rows = evidence.withColumn("own", F.zip_with(text, said, lambda a, b: a + b)).withColumn("soft", _softmax(F.col("own")))
    rows = cut(rows)
    sums = [F.sum(F.get("soft", F.lit(i))).alias(f"s{i}") for i in range(k)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    as_array = F.array(*[F.col(f"s{i}") for i in range(k)])
    host = cut(rows.groupBy("suffix", "domain", "host").agg(*sums))
    domain = host.groupBy("suffix", "domain").agg(*again)
    suffix = domain.groupBy("suffix").agg(*again)
    world = suffix.agg(*again).select(as_array.alias("c0"))

    def shares(counts: Column, prior: Column) -> Column:
        """Counts smoothed by `strength` rows of the prior."""
        sums = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return let(sums, lambda total: F.zip_with(counts, prior, lambda c, p: (c + strength * p) / (total + strength)))

    uniform = F.array_repeat(F.lit(1.0 / k), k)
    p_suffix = suffix.select("suffix", as_array.alias("c1")).join(F.broadcast(world), F.lit(True)).select("suffix", shares(F.col("c1"), shares(F.col("c0"), uniform)).alias("p1"))
    p_domain = domain.select("suffix", "domain", as_array.alias("c2")).join(p_suffix.withColumnRenamed("suffix", "sx"), F.col("suffix").eqNullSafe(F.col("sx"))).select("suffix", "domain", shares(F.col("c2"), F.col("p1")).alias("p2"))
    counts = host.select(F.col("suffix").alias("sx"), F.col("domain").alias("dm"), F.col("host").alias("ht"), as_array.alias("c3"))
    p_host = counts.join(p_domain, F.col("sx").eqNullSafe(F.col("suffix")) & F.col("dm").eqNullSafe(F.col("domain"))).select("sx", "dm", "ht", "c3", "p2")
    same = F.col("suffix").eqNullSafe(F.col("sx")) & F.col("domain").eqNullSafe(F.col("dm")) & F.col("host").eqNullSafe(F.col("ht"))
    joined = rows.join(p_host, same)
    others = F.zip_with("c3", "soft", lambda c, s: F.greatest(c - s, F.lit(0.0)))
    posterior = _softmax(F.zip_with(F.col("own"), shares(others, F.col("p2")), lambda a, p: a + F.log(p)))
    best = lambda c: F.get(langs, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    out = joined.withColumn("posterior", posterior)
    return out.select(
        "key", "declared", "host", "n", best(F.col("posterior")).alias("lang"), F.round(F.array_max("posterior"), 6).alias("confidence"),
        F.when(F.col("n") > 0, best(F.col("mean"))).alias("text_lang"), F.when(F.col("n") > 0, F.array_max("mean")).alias("mean_loglik"),
    )


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, text, declared, host, domain, suffix) of raw pages."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.col(html_col), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    text = F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w{1,8};", " ")
    rows = pages.select(F.col(id_col).cast("long").alias("key"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return rows.withColumns({"domain": F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), "suffix": F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit(""))})


def document_rows(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """The same of documents: lang is the declared language, source stands for the host."""
    none = F.lit(None).cast("string")
    key = F.col("doc_id").cast("long") if key is None else key
    return docs.select(key.alias("key"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"), F.col("source").cast("string").alias("host"), none.alias("domain"), none.alias("suffix"))


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    return fuse(text_evidence(page_rows(pages), model), model)


def rejected(found: DataFrame, languages: list[str], floor: float = FLOOR, sure: float = 0.999) -> DataFrame:
    """Keys of rows that are in no known language: no letters, or, unless their declared language has no model among
    `languages`, trigrams unlike every language or surely not the declared one."""
    unlike = F.col("mean_loglik") < floor
    other = F.col("declared").isNotNull() & (F.col("declared") != F.col("lang")) & (F.col("confidence") >= sure)
    judged = F.col("declared").isNull() | F.array_contains(F.array(*map(F.lit, languages)), F.col("declared"))
    return found.where((F.col("n") == 0) | judged & F.coalesce(unlike | other, F.lit(False))).select("key").distinct()


def accept(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs` whose language is known; a model fitted on their own lang column unless one is given.

    Rows are told apart by a hash of all that is judged, so that null and repeated ids do no harm.
    """
    model = model or train(docs)
    if not model.languages:
        return docs
    key = F.xxhash64("doc_id", "text", "lang", "source")
    bad = small_side(cut(rejected(fuse(text_evidence(document_rows(docs, key), model), model), model.languages)))
    row, bad_row = free_names(docs, "_row", "_bad_row")
    return docs.withColumn(row, key).join(bad.toDF(bad_row), F.col(row) == F.col(bad_row), "left_anti").drop(row)
