"""Quality classifier by hierarchical empirical Bayes.

A logistic model gives each document a probability from its text. Sums of these probabilities by host and path are
shrunk twice: a path towards its host, a host towards all documents, each as far as its few documents and the spread
between sites ask for. A document's final log-odds are those of its text plus those of its site, less those of the
corpus, with its own share taken out of the site. Sparse sites therefore decide next to nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.pretok import lean, slices
from quern.llm.shingles import word_hashes
from quern.session import written

#: Most labelled documents that the text model is fitted on: those of least hash of doc_id.
SAMPLE = 20_000
#: Probabilities are kept in millionths, so that sums do not depend on the order of rows.
UNIT = 1_000_000
#: Documents of a lower final probability are rejected.
THRESHOLD = 0.5
#: Bounds of the prior strengths, in documents.
STRENGTHS = (1.0, 1e6)

_UPPER, _DIGIT, _SYMBOL, _MARK, _POINT, _SPACE, _WIDE = range(1, 8)
_KIND = np.full(0x110000, _WIDE, np.uint8)
_KIND[:128] = 0
_KIND[65:91] = _UPPER
_KIND[48:58] = _DIGIT
for _c in "#*$%&|<>@\\^_~{}[]=+/":
    _KIND[ord(_c)] = _SYMBOL
for _c in "!?":
    _KIND[ord(_c)] = _MARK
for _c in ".,;:'\"()-`":
    _KIND[ord(_c)] = _POINT
for _c in " \t\n\x0b\x0c\r":
    _KIND[ord(_c)] = _SPACE
#: Surface measures, then shares of words by the bucket that their hash falls into.
SURFACE, WORDS = 14, 128
FEATURES = SURFACE + WORDS


def features(texts: list[str]) -> np.ndarray:
    """(texts, FEATURES): lengths, shares of kinds of characters, measures of repetition, and hashed words with A-Z
    lower-cased. Empty texts: zeros."""
    out = np.zeros((len(texts), FEATURES))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    kinds = _KIND[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(owner * 8 + kinds, minlength=8 * len(texts)).reshape(-1, 8)
    out[:, :7] = np.sqrt(counts[:, 1:] / np.maximum(sizes, 1)[:, None])
    for k, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if not n:
            continue
        lines = [x for x in t.split("\n") if x.strip()]
        bigrams = set(zip(words, words[1:], strict=False))
        out[k, 7:SURFACE] = (
            math.log1p(n),
            math.log(sum(map(len, words)) / n),
            len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            1 - len(bigrams) / max(1, n - 1),
            1 - len(set(lines)) / len(lines),
            math.log1p(len(t) / len(lines)) / 5,
        )
    hashes, counts = word_hashes(texts)
    place = np.repeat(np.arange(len(texts)) * WORDS, counts) + (hashes % np.uint64(WORDS)).astype(np.int64)
    found = np.bincount(place, minlength=WORDS * len(texts)).reshape(-1, WORDS)
    out[:, SURFACE:] = np.sqrt(found / np.maximum(counts, 1)[:, None])
    return out


class Logistic(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = _expanded((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _expanded(x: np.ndarray) -> np.ndarray:
    """Clipped values, the squares of the surface measures, and 1."""
    x = np.clip(x, -6, 6)
    return np.column_stack([x, x[:, :SURFACE] ** 2, np.ones(len(x))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
    """Newton's method with a ridge. Without both classes the model is the share of the one that is there."""
    if not len(y):
        return Logistic(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + SURFACE + 1))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    a = _expanded((x - mean) / scale)
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - penalty * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id, label, x): features of at most `sample` labelled documents. The sample is bounded, so it is broadcast."""
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna().dropDuplicates(["id"])
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # An id may have several rows or texts: the first text of each counts, so the bound holds for rows too.
    found = found.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first("label").alias("label")).select("id", "label", "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = [t or "" for t in b.column("text").to_pylist()], []
            for part in slices(texts):
                rows.extend(features(part).tolist())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "label", "x"])

    return found.select("id", "label", "text").mapInArrow(run, "id long, label int, x array<double>")


def fit_documents(docs: DataFrame, labels: DataFrame, **options) -> Logistic:
    """The text model, fitted on the driver on the bounded sample; in order of id, so that it is the same each time."""
    rows = sorted(training_rows(docs, labels, **options).collect(), key=lambda r: (r.id, r.label, r.x))
    return fit_logistic(np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r.label for r in rows], float))


def document_scores(df: DataFrame, model: Logistic, text_col: str = "text") -> DataFrame:
    """`df` without its text and with p: the probability of the text in millionths. A null text is an empty one."""
    names = [c for c in df.columns if c not in (text_col, "p")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [model.probability(features(part)) for part in slices([t or "" for t in b.column(text_col).to_pylist()])]
            p = np.rint(np.concatenate(parts or [np.empty(0)]) * UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(p)], names=[*names, "p"])

    return df.select(*names, text_col).mapInArrow(lean(run), df.select(*names, F.lit(0).cast("long").alias("p")).schema)


def strength(n: float, total: float, squares: float, sites: float, mean: float) -> float:
    """Prior strength from the spread between sites, by moments: `squares` is the sum of n * (site mean - mean)^2."""
    within = mean * (1 - mean)
    if sites < 2 or within <= 0 or n - total / n <= 0:
        return STRENGTHS[1]
    between = (squares - (sites - 1) * within) / (n - total / n)
    return min(max(within / between - 1, STRENGTHS[0]), STRENGTHS[1]) if between > 0 else STRENGTHS[1]


def url_site(url: Column, depth: int = 1) -> tuple[Column, ...]:
    """Host of a URL and its first 1, 2, ..., `depth` path segments: a site and nested parts of it. Null for no URL."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    segments = lambda n: F.regexp_extract(url, rf"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*((?:/[^/?#]*){{1,{n}}})", 1)
    parts = (F.when(url.isNotNull(), F.coalesce(F.nullif(segments(n + 1), F.lit("")), F.lit("/"))) for n in range(depth))
    return F.nullif(host, F.lit("")), *parts


def page_text(html: Column) -> Column:
    """The text of a page: without scripts, styles and comments; tags are breaks, the commonest entities characters."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "\n")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"\s*\n\s*", "\n"), F.lit(" \n"))


def nested_posteriors(scored: DataFrame, levels: tuple[str, ...]) -> tuple[DataFrame, float]:
    """(levels..., n, s, prior, k) for each innermost site, and the mean of all documents.

    `levels` go from the whole site to its innermost part. prior is the posterior mean of the part around a site, which
    is itself drawn towards that around it, and so on up to the mean; k is the strength with which the innermost sites
    are drawn. Innermost sites are summed first, those around from them; only three moments of each level come to the
    driver.
    """
    inner = written(scored.groupBy(*levels).agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    whole = inner.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not whole.n:
        return inner.select("*", F.lit(0.5).alias("prior"), F.lit(1.0).alias("k")), 0.5
    mean = min(max(whole.s / whole.n / UNIT, 1e-6), 1 - 1e-6)

    def moments(df: DataFrame) -> float:
        off = F.col("s") / F.col("n") / UNIT - F.col("prior")
        m = df.agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"), F.sum(F.round(F.col("n") * off * off * 1e9).cast("decimal(30,0)")).alias("sq"), F.count("*").alias("c")).first()
        return strength(float(whole.n), float(m.nn), float(m.sq) / 1e9, float(m.c), mean)

    around = None  # posteriors of the level before
    for depth in range(1, len(levels) + 1):
        own = levels[:depth]
        level = inner if depth == len(levels) else inner.groupBy(*own).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        if around is None:
            level = level.withColumn("prior", F.lit(mean))
        else:
            same = [level[c].eqNullSafe(around[f"{c}_"]) for c in own[:-1]]
            level = level.join(around, reduce(Column.__and__, same)).drop(*(f"{c}_" for c in own[:-1]))
        k = moments(level)
        posterior = (F.col("s") / UNIT + F.lit(k) * F.col("prior")) / (F.col("n") + F.lit(k))
        if depth < len(levels):
            around = level.select(*(F.col(c).alias(f"{c}_") for c in own), posterior.alias("prior"))
    return level.select(*levels, "n", "s", "prior", F.lit(k).alias("k")), mean


def site_posteriors(scored: DataFrame, host_col: str, path_col: str) -> tuple[DataFrame, float]:
    """(host, path, n, s, prior, k) for each path, and the mean of all documents: nested_posteriors of two levels."""
    return nested_posteriors(scored.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), "p"), ("host", "path"))


def site_quality(df: DataFrame, model: Logistic, host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", deeper: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of `df`: doc_id, p_doc, p_site, p_quality, kept.

    Sites nest: host, path, and the columns `deeper`. Null hosts and paths are sites of their own. Null and empty texts
    get the model's value for no text. Rows that are repeated count each. Sites join by their keys; Spark broadcasts them
    if they are few and splits hot ones if not. A text is worked on as a whole, whatever its length.
    """
    columns = (host_col, path_col, *deeper)
    levels = tuple(f"level{k}" for k in range(len(columns)))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).cast("string").alias(x) for c, x in zip(columns, levels, strict=True)))
    scored = written(document_scores(rows, model), "scored")
    sites, mean = nested_posteriors(scored, levels)
    sites = written(sites.select(*(F.col(x).alias(f"{x}_") for x in levels), "n", "s", "prior", "k"), "sites")
    both = scored.join(sites, reduce(Column.__and__, (scored[x].eqNullSafe(sites[f"{x}_"]) for x in levels)))
    p = F.greatest(F.least(F.col("p") / UNIT, F.lit(1 - 1e-6)), F.lit(1e-6))
    site = ((F.col("s") - F.col("p")) / UNIT + F.col("k") * F.col("prior")) / (F.col("n") - 1 + F.col("k"))
    site = F.greatest(F.least(site, F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = F.log(p / (1 - p)) + F.log(site / (1 - site)) - F.lit(math.log(mean / (1 - mean)))
    both = both.select("doc_id", F.round(p, 6).alias("p_doc"), F.round(site, 6).alias("p_site"), F.round(1 / (1 + F.exp(-odds)), 6).alias("p_quality"))
    return both.withColumn("kept", F.col("p_quality") >= threshold)


def op4_hierarchical_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every whole document from its text and the documents of its source and language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return site_quality(docs, model)


def page_site_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every page from its text and the pages of its host, its first path segment, and its first two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    host, path, inner = url_site(F.col("url"), 2)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", page_text(F.col("html")).alias("text"), host.alias("host"), path.alias("path"), inner.alias("inner"))
    return site_quality(pages, model, "host", "path", id_col="page_id", deeper=("inner",)).withColumnRenamed("doc_id", "page_id")
