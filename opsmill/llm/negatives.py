"""Hard negatives: rows of another label that are nearly as close to an anchor as its positives.

Search is by inner product, in the manner of length buckets with coordinate lists. Rows are
dealt by range of their length, the longest first, and packed into buckets of rows of like
length; a bucket keeps for every coordinate the order of its rows by that coordinate of the
unit vector. For an anchor and a score still worth finding, the length of a bucket's longest
row gives the least cosine asked of its rows. If that is over one, the bucket is left out;
else it gives for each focus coordinate (those in which the anchor is largest) a range that a
row's coordinate must be in. The ranges are looked up in the coordinate lists, their rows are
intersected, and what is left is verified with whole products. Where the ranges leave most of
a bucket, the bucket is verified with one matrix product for all such anchors.

Anchors (blocks of ``BLOCK``) and buckets (parts of ``PART`` rows) meet in cells of a grid, one
group of an Arrow function each, so that a cell has a bound however many rows and anchors
there are; a cell keeps the best of every search only. The first pass finds positives, with
the score worth finding rising as they are found. The second knows the scores of all
positives, so it asks from the start for the least score that any band admits.

Defined cases: rows with a null label, vector, identifier or component, or a component that
is not finite, take no part; rows that share an identifier count as the one with the smallest
label, then vector; vectors that are shorter than others have zeros at their end; anchors
without positives, and positives with a negative score (their band is empty), give no rows;
an empty table gives an empty result; scores are exact if they fit a long; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsmill.llm.common import batch_of, small_batches, table, written

#: Rows of a bucket, rows of a part of the table and anchors of a block, which meet in a cell.
BUCKET, PART, BLOCK = 1024, 16_384, 16_384
#: Focus coordinates of an anchor.
FOCUS = 3
#: Part of a bucket up to which candidates are verified one anchor at a time.
FEW = 0.2
#: Scores in one matrix product.
SCORES = 1 << 21
_SLACK = 1e-9

_INDEX = "part int, longest double, ids binary, labels binary, vectors binary, lists binary"
_INDEX_ARROW = pa.schema(
    [("part", pa.int32()), ("longest", pa.float64())] + [(c, pa.binary()) for c in ("ids", "labels", "vectors", "lists")]
)
_FOUND = "anchor_id long, slot int, vec_id long, score long"
_FOUND_ARROW = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def scaled(vector: Column) -> Column:
    """256 times every entry, rounded down, as longs; what doesn't fit is the nearest long."""
    top = float(2**63)
    fit = lambda v: F.when(v >= top, F.lit(2**63 - 1)).when(v < -top, F.lit(-(2**63))).otherwise(v.cast("long"))
    return F.transform(vector, lambda c: fit(F.floor(c.cast("double") * 256).cast("double")))


def padded(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of longs as a matrix, with zeros behind short lists."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    sizes = np.diff(rows.offsets.to_numpy())
    out = np.zeros((len(rows), width), np.int64)
    at = np.repeat(np.arange(len(rows)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rows.flatten().to_numpy()
    return out


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and unit vectors; a vector without length stays as it is."""
    values = vectors.astype(float)
    lengths = np.sqrt((values**2).sum(axis=1))
    return lengths, values / np.where(lengths > 0, lengths, 1)[:, None]


def _packed(width: int):
    """Buckets of the rows of a part, which come by falling length."""

    def bucket(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> list:
        lengths, units = _units(vectors)
        lists = np.argsort(units, axis=0, kind="stable").T.astype("<u2")
        part = TaskContext.get().partitionId()
        return [part, float(lengths.max()), ids.tobytes(), labels.tobytes(), vectors.tobytes(), lists.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(n: int) -> pa.RecordBatch:
            nonlocal held
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            held = [tuple(c[n:] for c in whole)]
            return batch_of(_INDEX_ARROW, [[v] for v in bucket(*(c[:n] for c in whole))])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("vec_id", "label")]
            held.append((*columns, padded(batch.column("x"), width)))
            while sum(len(h[0]) for h in held) >= BUCKET:
                yield out(BUCKET)
        left = sum(len(h[0]) for h in held)
        if left:
            yield out(left)

    return run


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (changed where vec_id is divisible by seven) and x of the rows that take part."""
    label = F.col("label").cast("long")
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & label.isNotNull() & finite(F.col("embedding")))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
            scaled(F.col("embedding")).alias("x"),
        )
        .groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row"))
        .select("vec_id", "row.label", "row.x")
    )


class _Search:
    """The best rows of every slot of a block of anchors, bucket by bucket.

    A slot is a band of scores (low to high) of an anchor; ``count`` rows of it are kept, those with
    the highest scores, then the smallest identifiers.
    """

    def __init__(self, ids, labels, vectors, low, high, same: bool, count: int) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.low, self.high, self.same, self.count = low, high, same, count
        self.lengths, self.units = _units(vectors)
        self.focus = np.argsort(-np.abs(self.units), axis=1, kind="stable")[:, :FOCUS]
        self.phi = np.arccos(np.clip(np.take_along_axis(self.units, self.focus, axis=1), -1, 1))
        self.best = [np.empty(0, np.int64)] * 3  # slot of an anchor, score, vec_id
        self.worth = np.where(low <= high, low, np.inf)
        self.verified = 0

    def ranges(self, theta: np.ndarray, longest: float, units: np.ndarray, lists: np.ndarray, live: np.ndarray):
        """Where the ranges of the live anchors' focus coordinates begin and end in the coordinate lists."""
        n = lists.shape[1]
        begin, end = np.zeros((len(live), self.focus.shape[1]), np.int64), np.full((len(live), self.focus.shape[1]), n)
        scale = self.lengths[live] * longest
        bound = np.flatnonzero((theta > 0) & (scale > 0))
        alpha = np.arccos(np.clip(theta[bound] / scale[bound] - _SLACK, -1, 1))
        phi = self.phi[live[bound]]
        least = np.cos(np.minimum(np.pi, phi + alpha[:, None])) - _SLACK
        most = np.cos(np.maximum(0, phi - alpha[:, None])) + _SLACK
        focus = self.focus[live[bound]]
        for coordinate in np.unique(focus):
            row, k = np.nonzero(focus == coordinate)
            values = units[lists[coordinate], coordinate]
            begin[bound[row], k] = np.searchsorted(values, least[row, k], "left")
            end[bound[row], k] = np.searchsorted(values, most[row, k], "right")
        return begin, end

    def look(self, longest: float, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lists: np.ndarray) -> None:
        theta = self.worth.min(axis=1)
        live = np.flatnonzero(theta <= self.lengths * longest * (1 + _SLACK) + _SLACK)
        if not len(live):
            return
        lengths, units = _units(vectors)
        begin, end = self.ranges(theta[live], longest, units, lists, live)
        width = np.maximum(end - begin, 0)
        few = width.min(axis=1) <= FEW * len(ids)
        # Products of whole numbers below two to the 53rd are exact as doubles.
        kind = float if self.lengths.max() * longest < 2**52 else np.int64
        rows = vectors.astype(kind)
        found = []
        rank = None
        for i in np.flatnonzero(few & (width.min(axis=1) > 0)):
            if rank is None:
                rank = np.argsort(lists, axis=1)
            focus, order = self.focus[live[i]], np.argsort(width[i])
            at = lists[focus[order[0]], begin[i, order[0]] : end[i, order[0]]].astype(np.int64)
            for k in order[1:]:
                place = rank[focus[k], at]
                at = at[(place >= begin[i, k]) & (place < end[i, k])]
            if len(at):
                self.verified += len(at)
                score = rows[at] @ self.vectors[live[i]].astype(kind)
                keep = score >= theta[live[i]]
                found.append((np.full(keep.sum(), live[i]), at[keep], score[keep].astype(np.int64)))
        many = live[~few]
        step = max(1, SCORES // len(ids))
        for part in (many[k : k + step] for k in range(0, len(many), step)):
            self.verified += len(part) * len(ids)
            score = self.vectors[part].astype(kind) @ rows.T
            hit = score >= self.worth[part].min(axis=1)[:, None]
            hit &= (self.labels[part][:, None] == labels[None, :]) == self.same
            a, at = np.nonzero(hit)
            self.keep(part[a], at, score[a, at].astype(np.int64), ids, labels)
        if found:
            self.keep(*(np.concatenate(c) for c in zip(*found, strict=True)), ids, labels)

    def keep(self, anchor: np.ndarray, at: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        right = ((self.labels[anchor] == labels[at]) == self.same) & (self.ids[anchor] != ids[at])
        anchor, at, score = anchor[right], at[right], score[right]
        slots = self.low.shape[1]
        new = [self.best]
        for j in range(slots):
            fits = (score >= self.low[anchor, j]) & (score <= self.high[anchor, j])
            new.append([anchor[fits] * slots + j, score[fits], ids[at[fits]]])
        slot, score, vec_id = (np.concatenate(c) for c in zip(*new, strict=True))
        order = np.lexsort((vec_id, ~score, slot))  # the complement turns the order without overflow
        slot, score, vec_id = slot[order], score[order], vec_id[order]
        begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])[: len(slot)])
        nth = np.arange(len(slot)) - np.repeat(begins, np.diff(np.append(begins, len(slot))))
        full = nth == self.count - 1
        worth = self.worth.reshape(-1)
        worth[slot[full]] = np.maximum(worth[slot[full]], score[full].astype(float))
        kept = nth < self.count
        self.best = [slot[kept], score[kept], vec_id[kept]]


def _cell(width: int, same: bool, count: int):
    """The search of a block of anchors in a part of the index."""

    def run(anchors: pa.Table, index: pa.Table) -> pa.Table:
        if not anchors.num_rows or not index.num_rows:
            return _FOUND_ARROW.empty_table()
        ids, labels = (anchors.column(c).to_numpy() for c in ("vec_id", "label"))
        scores = anchors.column("scores").to_pylist()
        slots = 1 if same else max(map(len, scores))
        low, high = np.full((len(ids), slots), -np.inf), np.full((len(ids), slots), np.inf)
        if not same:
            low, high = np.full(low.shape, 1), np.full(low.shape, 0)
            for i, own in enumerate(scores):
                for j, score in enumerate(own):
                    low[i, j], high[i, j] = score - score // 5, score
        search = _Search(ids, labels, padded(anchors.column("x"), width), low, high, same, count)
        for longest, *packed in sorted(zip(*(index.column(c).to_pylist() for c in _INDEX_ARROW.names[1:])), reverse=True):
            own, kinds, vectors, lists = packed
            own, kinds = np.frombuffer(own, np.int64), np.frombuffer(kinds, np.int64)
            vectors = np.frombuffer(vectors, np.int64).reshape(len(own), width)
            search.look(longest, own, kinds, vectors, np.frombuffer(lists, "<u2").reshape(width, len(own)))
        slot, score, vec_id = search.best
        return pa.table([ids[slot // slots], (slot % slots).astype("i4"), vec_id, score], schema=_FOUND_ARROW)

    return run


def _best(anchors: DataFrame, index: DataFrame, parts: int, blocks: int, width: int, same: bool, count: int) -> DataFrame:
    """anchor_id, slot, vec_id, score and rank of the best rows of every slot."""
    cells = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = cells.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(_cell(width, same, count), _FOUND)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and x (array of longs); anchors are the rows whose vec_id ``every`` divides.
    Negatives score from 80 to 100 hundredths of their positive.
    """
    spark = rows.sparkSession
    small_batches(spark, BUCKET)
    rows = written(rows, "vectors")
    anchor = F.col("vec_id") % every == 0
    n, anchored, width = rows.agg(F.count(F.lit(1)), F.count_if(anchor), F.max(F.size("x"))).first()
    width = max(width or 0, 1)
    blocks = max(1, -(-anchored // BLOCK))
    by_length = [F.desc("length"), F.col("vec_id")]
    length = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    index = written(
        rows.withColumn("length", length)
        .repartitionByRange(max(1, -(-n // PART)), *by_length).sortWithinPartitions(*by_length)
        .mapInArrow(_packed(width), _INDEX),
        "buckets",
    )
    parts = 1 + (index.agg(F.max("part")).first()[0] or 0)
    anchors = rows.filter(anchor).withColumn("scores", F.array().cast("array<long>"))
    near = written(_best(anchors, index, parts, blocks, width, True, positives), "positives")
    by_rank = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"])
    known = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(by_rank.alias("scores"))
    hard = _best(anchors.drop("scores").join(known, "vec_id"), index, parts, blocks, width, False, negatives)
    named = near.select(
        "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return hard.join(named, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth of ``embeddings``."""
    return hard_negatives(prepared(table(spark, sf_dir, "embeddings")))


OP11_SQL = r"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM whole a JOIN whole r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
