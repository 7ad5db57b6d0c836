"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. `fit` counts in how many training documents each hashed n-gram occurs, over all of them.
2. The weights are fitted by follow-the-regularised-leader with an elastic net on a bounded
   sample: about SAMPLE documents of each language, SAMPLE_IN_ALL at most of all, those whose
   hash of doc_id and text lies below a bound that the language's size sets. Their sparse features, at most BUCKETS entries a document, come to the driver.
3. A temperature is fitted on a fifth of that sample, which the weights never see.
4. `predict` scores whole texts; it reads nothing but the text.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is
every text when nothing can be learned; training rows without a language are left out, and so
are those of languages beyond the LANGUAGES most frequent ones;
rows repeated in doc_id and text train once; of equal scores the language first in the
alphabet is taken; an empty table gives no rows; texts are read
whole. `predict` replaces columns of the names it adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages that are learned at most: those with the most documents, the first in the alphabet of equals.
LANGUAGES = 200
#: Sampled documents of a language (about, by a bound on a hash) and of all, and passes over the sample.
SAMPLE_IN_ALL = 20_000
SAMPLE, PASSES = 500, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the character n-grams of the lower-cased text."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = []
    for order in ORDERS:
        if len(points) >= order:
            h = np.full(len(points) - order + 1, order, np.uint32)
            for k in range(order):
                h = (h ^ points[k : len(points) - order + 1 + k]) * _ODD[k]
                h ^= h >> np.uint32(15)
            hashes.append(h & np.uint32(BUCKETS - 1))
    found = np.concatenate(hashes)
    if len(found) < BUCKETS // 8:
        return np.unique(found, return_counts=True)
    counts = np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int) -> np.ndarray:
    """FTRL-proximal with L1 and L2 penalties over (buckets, values) rows."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at) -> np.ndarray:
        zs, ns = z[at], n[at]
        shrunk = np.where(np.abs(zs) <= L1, 0.0, np.sign(zs) * L1 - zs)
        return shrunk / ((BETA + np.sqrt(ns)) / ALPHA + L2)

    order = np.random.default_rng(0)
    for _ in range(PASSES):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            w = weights(at)
            error = _softmax(x @ w)
            error[labels[k]] -= 1
            g = x[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(slice(None))


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    lo, hi, ratio = -1.5, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(train: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the rows of `train` (doc_id, text, lang) that have a text and a language."""
    train = train.where("text is not null and lang is not null").select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                held[features(text.as_py())[0]] += 1
                held[BUCKETS] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["bucket", "docs"])

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["lang", "at", "n"])

    counted = train.select("text").mapInArrow(count, "bucket int, docs long")
    docs = np.zeros(BUCKETS + 1)
    for row in counted.groupBy("bucket").agg(F.sum("docs").alias("docs")).collect():  # BUCKETS + 1 rows at most
        docs[row.bucket] = row.docs
    idf = np.log((1 + docs[BUCKETS]) / (1 + docs[:BUCKETS])) + 1

    draw = F.xxhash64(F.lit("langid"), "doc_id", "text")
    # A language's sample are its rows below a bound on the draw, so no task ranks a language.
    most_frequent = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    sizes = {r.lang: r["count"] for r in most_frequent.collect()}
    most = min(sample, SAMPLE_IN_ALL // max(1, len(sizes)))
    bounds = [(lang, min(int(-(1 << 63) + min(1.0, most / n) * (1 << 64)), (1 << 63) - 1)) for lang, n in sizes.items()]
    below = train.sparkSession.createDataFrame(bounds, "lang string, bound long")
    drawn = train.withColumn("draw", draw).join(F.broadcast(below), "lang").where("draw <= bound").dropDuplicates(["lang", "draw"])
    found = drawn.select("lang", "text").mapInArrow(featurize, "lang string, at array<int>, n array<int>").collect()
    found.sort(key=lambda r: (r.lang, len(r.at), r.at[:50], r.n[:50]))
    languages = sorted({r.lang for r in found})
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)
    rows = [(np.array(r.at), _weighted(np.array(r.at), np.array(r.n), idf)) for r in found]
    labels = np.array([languages.index(r.lang) for r in found])
    aside = np.arange(len(rows)) % 5 == 4
    kept = np.flatnonzero(~aside)
    weights = fit_weights([rows[k] for k in kept], labels[kept], len(languages))
    held = np.array([rows[k][1] @ weights[rows[k][0]] for k in np.flatnonzero(aside)])
    return Model(languages, idf, weights, fit_temperature(held, labels[aside]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score; reads nothing but text."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.idf.astype(np.float32), model.weights.astype(np.float32), model.temperature)
    )
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at_text = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, idf, weights, temperature = shared.value
        for batch in batches:
            names, scores = [], []
            for value in batch.column(at_text):
                text = value.as_py()
                name, score = UNKNOWN, 0.0
                if languages and text is not None and any(map(str.isalpha, text)):
                    at, counts = features(text)
                    p = _softmax(_weighted(at, counts, idf) @ weights[at] / temperature)
                    name, score = languages[int(p.argmax())], float(p.max())
                names.append(name)
                scores.append(min(1.0, score))
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*(docs.schema[c] for c in keep), *added])
    quoted = [F.col(f"`{c}`") for c in keep]
    return docs.select(*quoted).mapInArrow(run, schema)


def held_out():
    """A fifth of the documents, by crc32 of doc_id as text; never trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
