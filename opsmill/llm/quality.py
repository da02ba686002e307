"""Quality: labelled neighbours in a latent-semantic space vote on every document.

Terms of a text are its character trigrams (white space counts as one blank) and the shapes of
its words (runs of capitals, small letters and digits as one sign each, other signs as they are,
so that ornaments, shouting and tables show), hashed into places of their own. Each of the two
has 1 + log of the counts, times the logarithm of how few of all documents have the term, at
length one. A few more terms are repetition: the part of words that stand again one to four
words later, and of lines that stood before, by square roots. The whole is brought to length one.

The latent space is spanned by the leading right singular vectors of the labelled texts, found
by subspace iteration. A document goes through the same projection, and is compared with every
labelled vector, block by block, by exact cosines; the ``NEIGHBOURS`` nearest vote with their
cosines as weights, and the score is the share of the votes for label 1.

Document frequencies are counted over all documents. Labelled texts are at most ``MAX_EACH`` of
either label, those with the smallest hash of their identifier, so that their vectors and the
projection have a bound and go to all tasks.

Defined cases: a null text is empty; a text without terms, or without a labelled neighbour on
its side of the space, gets the share of label 1 among the labelled texts held; unlabelled,
null, other and contradicting labels are left out, as are labels of documents that are missing;
of texts that share a labelled identifier the least counts; without labels every score is 0.5;
equal cosines (to five digits) go by the hash of the labelled identifier. Identifier, language and source
are never terms; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm.common import as_bytes, batch_of, crc_text, small_batches, table

#: Labelled texts of either label.
MAX_EACH = 2000
#: Places of trigrams (a power of two) and of shapes, dimensions of the latent space, neighbours that vote.
TRIGRAMS, SHAPES, DIMENSIONS, NEIGHBOURS = 1 << 13, 1 << 10, 64, 25
THRESHOLD = 0.5
_ROUNDS = 4
_LAGS = 4
TERMS = TRIGRAMS + SHAPES + _LAGS + 1

_SHAPE = bytearray(range(256))
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isupper():
        _SHAPE[_c] = ord("A")
    elif chr(_c).isascii() and chr(_c).islower() or _c >= 0x80:
        _SHAPE[_c] = ord("a")
    elif chr(_c).isdigit() and _c < 0x80:
        _SHAPE[_c] = ord("0")
_SHAPE = bytes(_SHAPE)
_RUN = re.compile(rb"(.)\1+", re.S)


class _Places(dict):
    """The place of a shape, remembered."""

    def __missing__(self, shape: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        short = _RUN.sub(rb"\1", shape)
        value = self[shape] = TRIGRAMS + xxhash.xxh3_64_intdigest(short) % SHAPES
        return value


_PLACES = _Places()


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the trigrams and shapes of a text, rising, and how often each occurs."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    # A trigram is of characters, however many bytes they have.
    spaced = f" {b' '.join(words).decode('utf-8', 'replace')} "
    points = np.frombuffer(spaced.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    code = (points[:-2] << np.uint64(42)) ^ (points[1:-1] << np.uint64(21)) ^ points[2:]
    code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - TRIGRAMS.bit_length())
    shapes = np.fromiter(map(_PLACES.__getitem__, text.translate(_SHAPE).split()), np.int64)
    counts = np.bincount(np.concatenate([code.astype(np.int64), shapes]), minlength=TERMS)
    places = np.flatnonzero(counts)
    return places, counts[places].astype(float)


def repetition(text: bytes) -> np.ndarray:
    """Parts of the words that stand again at each lag, and of the lines that stood before."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    out = [sum(map(bytes.__eq__, words[lag:], words)) / max(len(words), 1) for lag in range(1, _LAGS + 1)]
    return np.array([*out, 1 - len(set(lines)) / max(len(lines), 1)])


def _length_one(weights: np.ndarray) -> np.ndarray:
    return weights / max(np.sqrt((weights**2).sum()), 1e-12)


def weighed(text: bytes, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the terms of a text, of length one (or no terms)."""
    places, counts = terms(text)
    if not len(places):
        return places, counts
    weights = (1 + np.log(counts)) * rarity[places]
    cut = np.searchsorted(places, TRIGRAMS)
    again = np.sqrt(repetition(text))
    weights = _length_one(np.concatenate([_length_one(weights[:cut]), _length_one(weights[cut:]), again]))
    return np.append(places, np.arange(TERMS - len(again), TERMS)), weights


@dataclass
class Model:
    rarity: np.ndarray
    projection: np.ndarray  # terms by dimensions
    vectors: np.ndarray  # of the labelled texts, of length one or zero
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[bytes]) -> np.ndarray:
        """Latent vectors of texts, of length one; zero for those that have none."""
        out = np.zeros((len(texts), self.projection.shape[1]))
        for i, text in enumerate(texts):
            places, weights = weighed(text, self.rarity)
            out[i] = weights @ self.projection[places]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(length > 1e-9, out / np.where(length > 1e-9, length, 1), 0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        near = np.round(self.latent(texts) @ self.vectors.T, 5)
        k = min(NEIGHBOURS, near.shape[1])
        # The k nearest: all that are nearer than the k-th, and the first of those as near as it.
        edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k][:, None]
        above, level = near > edge, near == edge
        level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
        votes = np.where(above | level, np.maximum(near, 0), 0)
        total = votes.sum(axis=1)
        share = votes @ self.labels / np.where(total > 0, total, 1)
        return np.where(total > 0, np.clip(share, 0, 1), self.prior)


def held_out(doc_id: Column) -> Column:
    return crc_text(doc_id) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, label: str, max_each: int) -> DataFrame:
    """text and label of a bounded, fixed sample of the labelled documents, in its order."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("most")
    ).filter("label = most and label in (0, 1)")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.filter("label = 1").orderBy(*order).limit(max_each).unionByName(
        known.filter("label = 0").orderBy(*order).limit(max_each)
    )
    ids = ids.select(F.col("doc_id").alias("labelled_id"), "label")
    # At most twice max_each short rows, so that the documents need not move.
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"))
    return texts.groupBy("labelled_id").agg(F.min("label").alias("label"), F.min(F.coalesce("text", F.lit(""))).alias("text"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a task have each term; place -1 counts the documents."""
    total, n = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for text in as_bytes(batch.column(0)):
            total[terms(text)[0]] += 1
        n += len(batch)
    held = np.flatnonzero(total)
    yield batch_of(pa.schema([("place", pa.int32()), ("docs", pa.int64())]), [[-1, *held.tolist()], [n, *total[held].tolist()]])


def rarity(docs: DataFrame) -> np.ndarray:
    """Logarithm of the part of all documents that lack nothing but the term, by place."""
    rows = docs.select("text").mapInArrow(_frequencies, "place int, docs long").groupBy("place").agg(F.sum("docs"))
    counted = dict(rows.collect())  # at most TERMS rows
    out = np.full(TERMS, 0.0)
    n = counted.pop(-1, 0)
    for place, having in counted.items():
        out[place] = np.log((1 + n) / (1 + having)) + 0.1
    return out


def _projection(rows: list[tuple[np.ndarray, np.ndarray]], dimensions: int) -> np.ndarray:
    """Leading right singular vectors of a sparse matrix, by subspace iteration with a fixed start."""
    dimensions = min(dimensions, len(rows))
    wide = min(dimensions + 16, len(rows), TERMS)
    at = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    place = np.concatenate([p for p, _ in rows])
    value = np.concatenate([w for _, w in rows])
    cut = np.searchsorted(at, np.arange(0, len(rows) + 256, 256))

    def through(basis: np.ndarray) -> np.ndarray:
        """The matrix's transpose times the matrix times ``basis``, in blocks of rows."""
        out = np.zeros_like(basis)
        for k, (begin, end) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            block = np.zeros((256, TERMS))
            block[at[begin:end] - 256 * k, place[begin:end]] = value[begin:end]
            out += block.T @ (block @ basis)
        return out

    basis = np.linalg.qr(np.random.default_rng(20240719).normal(size=(TERMS, wide)))[0]
    for _ in range(_ROUNDS):
        basis = np.linalg.qr(through(basis))[0]
    small = basis.T @ through(basis)
    order = np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :dimensions]
    return basis @ order


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_each: int = MAX_EACH) -> Model:
    """The labelled neighbours and their space; ``labels`` has doc_id and the label's column."""
    small_batches(docs.sparkSession)
    known = rarity(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", batch_id), ("label", pa.int32()), ("places", pa.binary()), ("weights", pa.binary())])
        for batch in batches:
            made = [weighed(t, known) for t in as_bytes(batch.column("text"))]
            packed = [[p.astype("<i4").tobytes() for p, _ in made], [w.tobytes() for _, w in made]]
            yield batch_of(schema, [batch.column("labelled_id").cast(batch_id), batch.column("label"), *packed])

    batch_id = pa.string()
    rows = sample(docs, labels, label, max_each).withColumn("labelled_id", F.col("labelled_id").cast("string"))
    held = rows.mapInArrow(run, "id string, label int, places binary, weights binary").collect()
    if not held:
        return Model(known, np.zeros((TERMS, 1)), np.zeros((0, 1)), np.empty(0), 0.5)
    held.sort(key=lambda r: (xxhash.xxh3_64_intdigest(r["id"]), r["id"]))
    vectors = [(np.frombuffer(r["places"], "<i4"), np.frombuffer(r["weights"])) for r in held]
    model = Model(known, _projection(vectors, DIMENSIONS), np.empty(0), np.array([r["label"] for r in held], float), 0.5)
    own = np.array([w @ model.projection[p] for p, w in vectors])
    length = np.linalg.norm(own, axis=1, keepdims=True)
    model.vectors = np.where(length > 1e-9, own / np.where(length > 1e-9, length, 1), 0)
    model.prior = float(model.labels.mean())
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by MAX_EACH, TERMS and DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("score", pa.float64())])
            yield batch_of(schema, [batch.column(0), shared.value.scores(as_bytes(batch.column(1)))])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learned from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return scored(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
