"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, everything but letters becomes one space, and its distinct
character n-grams (of words with their border spaces, 4 to 6 bytes of UTF-8) are its
features. The ratio of a feature is the logarithm of how much more often toxic texts
have it than others; the features with the strongest evidence are kept, scaled by their
ratio, and weighed by a logistic regression.

The model is fitted on at most ``MAX_TOXIC`` toxic and ``MAX_OTHER`` other labelled texts,
those with the smallest hash of their identifier, and holds at most ``MAX_FEATURES``
features; so it is small and goes to all tasks. Scores are taken row by row over whole
texts, with no shuffle.

Defined cases: null and empty texts have no features and get the score of the model's
intercept; unlabelled, null and repeated labels are left out, as are labels of documents
that are missing; without labels of both kinds every score is 0. Ties among hashes are
broken by identifier. Identifier, language and source are never features; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm.common import as_bytes, batch_of, crc_text, small_batches, table

MAX_TOXIC = 2000
MAX_OTHER = 6000
MAX_FEATURES = 6000
#: Texts of the sample that must have a feature.
MIN_TEXTS = 4
SIZES = (4, 5, 6)
THRESHOLD = 0.7
_PEEK_BITS = 20

_SPACES = re.compile(rb" +")
_LETTERS = bytearray(b" " * 256)
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _LETTERS[_c] = _LETTERS[_c - 32] = _c
_LETTERS[0x80:] = bytes(range(0x80, 0x100))
_LETTERS = bytes(_LETTERS)


def normal(text: bytes) -> bytes:
    return b" " + b" ".join(text.translate(_LETTERS).split()) + b" "


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Codes of all n-grams of a normalised text, one array per size; a code tells its size."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    code = np.zeros(len(raw), np.uint64)
    for size in range(1, max(SIZES) + 1):
        if len(raw) < size:
            return
        code = code[: len(raw) - size + 1] << np.uint64(8) | raw[size - 1 :]
        if size in SIZES:
            yield code


def _peek(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PEEK_BITS)


@dataclass
class Model:
    codes: np.ndarray  # of the features, sorted
    weights: np.ndarray  # already times their ratios
    intercept: float

    def __post_init__(self) -> None:
        self.peek = np.zeros(1 << _PEEK_BITS, bool)
        self.peek[_peek(self.codes)] = True

    def features(self, text: bytes) -> np.ndarray:
        """Numbers of the features of a text."""
        found = [code[self.peek[_peek(code)]] for code in grams(normal(text))]
        codes = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        return at[self.codes[at] == codes] if len(self.codes) else at[:0]

    def score(self, text: bytes) -> float:
        z = self.intercept + float(self.weights[self.features(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_other: int) -> DataFrame:
    """text and toxic of a bounded, fixed sample of the labelled documents."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("most")
    ).filter("toxic = most and toxic in (0, 1)")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.filter("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(max_other)
    )
    ids = ids.select(F.col("doc_id").alias("labelled_id"), "toxic")
    # At most max_toxic + max_other short rows, so that the documents need not move.
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id")).select(
        "text", F.col("toxic").cast("int").alias("toxic")
    )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of either kind have each n-gram, summed within a task."""
    schema = pa.schema([("code", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())])
    held: list[tuple[np.ndarray, ...]] = []

    def total() -> tuple[np.ndarray, ...]:
        codes = np.concatenate([h[0] for h in held])
        codes, at = np.unique(codes, return_inverse=True)
        return codes, *(np.bincount(at, np.concatenate([h[k] for h in held]), len(codes)) for k in (1, 2))

    for batch in batches:
        for text, toxic in zip(as_bytes(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            found = list(grams(normal(text)))
            if found:
                codes = np.unique(np.concatenate(found))
                held.append((codes, np.full(len(codes), toxic, float), np.full(len(codes), 1 - toxic, float)))
            if sum(len(h[0]) for h in held[1:]) > 2_000_000:
                held = [total()]
    if held:
        codes, toxic, other = total()
        for at in range(0, len(codes), 100_000):
            part = slice(at, at + 100_000)
            yield batch_of(
                schema,
                [codes[part].view(np.int64), toxic[part].astype("i8"), other[part].astype("i8")],
            )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_toxic: int = MAX_TOXIC,
    max_other: int = MAX_OTHER,
    max_features: int = MAX_FEATURES,
) -> Model:
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, max_toxic, max_other)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return Model(np.empty(0, np.uint64), np.empty(0), -60.0)
    have, lack = F.col("toxic") + F.col("other"), sum(sizes.values()) - F.col("toxic") - F.col("other")
    apart = F.col("toxic") * sizes[0] - F.col("other") * sizes[1]
    # Chi-square of having the feature and being toxic, up to a constant factor.
    evidence = apart.cast("double") * apart / (have * F.greatest(lack, F.lit(1)))
    ratio = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1) / ((F.col("other") + 0.5) / (sizes[0] + 1)))
    counted = (
        rows.mapInArrow(_counts, "code long, toxic long, other long")
        .groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .filter(F.col("toxic") + F.col("other") >= MIN_TEXTS)
        .select("code", ratio.alias("ratio"), evidence.alias("evidence"))
        .orderBy(F.desc("evidence"), "code").limit(max_features)
    )
    kept = sorted((r["code"], r["ratio"]) for r in counted.collect())
    codes = np.array([c for c, _ in kept], np.uint64)
    ratios = np.array([r for _, r in kept])
    finder = Model(codes, ratios, 0.0)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("toxic", pa.int32()), ("features", pa.binary())])
        for batch in batches:
            own = [finder.features(t).astype("<u2").tobytes() for t in as_bytes(batch.column("text"))]
            yield batch_of(schema, [batch.column("toxic"), own])

    data = rows.mapInArrow(found, "toxic int, features binary").collect()
    weights, intercept = _logistic(
        [np.frombuffer(r["features"], "<u2") for r in data], np.array([r["toxic"] for r in data], float), ratios
    )
    return Model(codes, weights * ratios, intercept)


def _logistic(features: list[np.ndarray], y: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a regularised logistic regression, by accelerated gradient steps.

    Both kinds of texts count alike in sum.
    """
    row = np.repeat(np.arange(len(y)), [len(f) for f in features])
    column = np.concatenate(features).astype(np.int64) if len(row) else np.empty(0, np.int64)
    value = ratios[column]
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(len(ratios)), 0.0
    look, look_b, t = w.copy(), b, 1.0
    # The steepest curve of the loss, by a few power steps on the weighted feature matrix.
    v = np.ones(len(ratios) + 1)
    top = 1.0
    for _ in range(12):
        z = np.bincount(row, value * v[column], len(y)) + v[-1]
        z *= share
        v = np.append(np.bincount(column, value * z[row], len(ratios)), z.sum())
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    decay = 1e-5
    step = 1 / (0.25 * top * 1.1 + decay)
    for _ in range(300):
        z = np.bincount(row, value * look[column], len(y)) + look_b
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * share
        gradient = np.bincount(column, value * error[row], len(ratios)) + decay * look
        new, new_b = look - step * gradient, look_b - step * error.sum()
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / following
        look, look_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b, t = new, new_b, following
    return w, float(b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_FEATURES features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("score", pa.float64())])
            yield batch_of(schema, [batch.column(0), [own.score(t) for t in as_bytes(batch.column(1))]])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep = [own.score(t) < threshold for t in as_bytes(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return crc_text(doc_id) % 3 == 1


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return scored(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
