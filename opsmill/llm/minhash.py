"""MinHash near-duplicates with an LSH forest.

Every document becomes the set of its distinct five-word shingles. Documents with equal
sets are one class, of which only the first goes on. A class has ``TREES`` paths of ``DEPTH``
minhash values; each tree is all paths in sorted order, dealt over tasks by range, and rows
at the borders of the ranges are compared across them.

Round one takes next neighbours in every tree that share enough values (``least``), and marks
the classes that have a neighbour farther off which shares as many. A sketch (the least hash
of every bin of hash values, in two bits) drops candidates that are surely too far apart.

A further round (``FURTHER``) sorts the marked classes by new trees, and takes neighbours that are
of different components: crowded regions are gone through again, with candidates in proportion to
classes and trees. From here on components grow by what is two links away.

What is left is joined exactly, however many there are in a region: the shingles
of a set are ordered by how often they occur, the rarest first, and two sets that are similar
enough share one of their first shingles, at places that leave room for the overlap needed.
In a crowd with a common template these are the shingles that a text does not share with the
crowd. Pairs that are in one component by now need no further link. The finer sketches
go with the shingles, so that a task compares them itself and gives out likely links only, not
the pairs of a group. This is done twice: first for the likeliest link of every two components,
then for all that are still apart. Shingles of many sets are parted over tasks.

Every candidate of all rounds is confirmed on the full sets of both texts. Components of the
confirmed links come from rounds of joins.

Words are the runs of anything but ASCII white space, with A-Z in lower case. Defined
cases: fewer than five words are one shingle; a document without words, and one with a null
identifier, is linked with nothing (null identifiers stay, each for itself); rows that share
an identifier count as one document that has all their sets; equal sets are always linked;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.llm.common import as_bytes, batch_of, only_once, small_batches, table, written
from opsmill.llm.components import components

SHINGLE = 5
TREES = 10
DEPTH = 8
#: Chance that no tree shows a link at the threshold.
MISSED = 1e-4
#: Frequencies of shingles are counted in so many buckets (a power of two).
BUCKETS = 1 << 20
#: Shingles of more sets than this (beyond what buckets usually hold) are parted over tasks.
CROWD = 512
#: Pairs of a shingle that are looked at in one step, and whose sketches are compared in one.
STEP, COMPARED = 1 << 22, 1 << 14
#: Bins of the sketches of both rounds; the finer ones are parts of the coarser.
COARSE, FINE = 128, 1024
#: Deviations by which a sketch may fall short of the similarity asked for.
DEVIATIONS = 4.5

#: Rounds of further trees for the marked classes.
FURTHER = 1

_PLACE = np.random.default_rng(20240607).integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)


@cache
def _forest(nth: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the hash functions of a round's trees."""
    random = np.random.default_rng(20240608 + nth)
    factors = random.integers(1, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
    return factors, random.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)


class _WordHash(dict):
    """64-bit hash by word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORD_HASH = _WordHash()


def shingles(text: bytes) -> np.ndarray:
    """64-bit hashes of the distinct shingles of a text, sorted."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_WORD_HASH.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    total = np.full(n - width + 1, np.uint64(width) * _PLACE[SHINGLE])
    for k in range(width):
        total += hashed[k : n - width + 1 + k] * _PLACE[k]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return np.unique(total)


def signature(found: np.ndarray, nth: int = 0) -> np.ndarray:
    """The minhash values of a set, one per tree and depth of a round."""
    factors, offsets = _forest(nth)
    short = found.astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        values = factors[:, None] * short[None, at : at + 512]
        values += offsets[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def sketch(found: np.ndarray, bins: int) -> bytes:
    """Two bits for every bin of hash values: 0 if it is empty, else 1 to 3 by its least value."""
    width = 64 - (bins.bit_length() - 1)
    starts = np.arange(bins, dtype=np.uint64) << np.uint64(width)
    at = np.searchsorted(found, starts)
    least = found[np.minimum(at, len(found) - 1)] if len(found) else starts
    held = (at < len(found)) & (least >> np.uint64(width) == np.arange(bins, dtype=np.uint64))
    mark = (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(3) + np.uint64(1)
    four = np.where(held, mark, np.uint64(0)).astype(np.uint8).reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).tobytes()


def likeness(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, similarity: float) -> tuple:
    """Similarity of sets as their sketches (rows of 64-bit words) show it, and its deviation where they are as similar as asked."""
    count = lambda bits: np.bitwise_count(bits).sum(axis=1).astype(float)
    one = np.uint64(1)
    low = np.uint64(0x5555555555555555)
    held_a, held_b = (a | a >> one) & low, (b | b >> one) & low
    differ = ((a ^ b) | (a ^ b) >> one) & low
    both, either = count(held_a & held_b), np.maximum(count(held_a | held_b), 1)
    equal = count((held_a | held_b) & ~differ)
    # Different least values get one mark in one of three cases.
    alike = (1.5 * equal - 0.5 * both) / either
    union = (sizes_a + sizes_b) / (1 + similarity)
    # Bins sample the union without replacement; marks add noise where bins hold different values.
    spread = similarity * (1 - similarity) * np.maximum(1 - either / np.maximum(union, 1), 0.02)
    return alike, np.sqrt((spread + 0.5 * np.clip(both / either - similarity, 0.01, 1 - similarity)) / either)


def far_apart(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets are surely less similar, by their sizes and sketches."""
    alike, spread = likeness(a, b, sizes_a, sizes_b, similarity)
    smaller, larger = np.minimum(sizes_a, sizes_b), np.maximum(sizes_a, sizes_b)
    return (alike < similarity - DEVIATIONS * spread) | (smaller < similarity * larger - 1e-6)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64())] + [(c, pa.binary()) for c in ("digest", "paths", "coarse", "fine")]
    )
    for batch in batches:
        rows = []
        for text in as_bytes(batch.column(1)):
            found = shingles(text)
            digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
            paths = signature(found).astype(">u4").tobytes()
            rows.append((len(found), digest, paths, sketch(found, COARSE), sketch(found, FINE)))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(5)]
        yield batch_of(schema, [batch.column(0).cast(pa.int64()), *columns])


def _wide(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def least(similarity: int) -> int:
    """How many minhash values candidates must share in a tree, by the similarity in hundredths."""
    missed = lambda depth: (1 - (similarity / 100) ** depth) ** TREES
    return max((d for d in range(1, DEPTH + 1) if missed(d) <= MISSED), default=1)


_ROWS = {
    "tree": pa.int32(), "path": pa.binary(), "node": pa.int64(), "component": pa.int64(), "n_shingles": pa.int64(),
    "sketch": pa.binary(),
}
_FOUND = "a long, b long, tree int, path binary, node long, component long, n_shingles long, sketch binary"
_FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), *_ROWS.items()])


def _neighbours(similarity: int):
    """Candidate links (a, b) of a sorted part of the forest, marked classes (b null), and its border rows (a null).

    Candidates are next to each other and of different components.
    The border rows are the first and the last two, which have neighbours in other parts.
    """
    enough = least(similarity)

    def links(a, b) -> pa.RecordBatch:
        return batch_of(_FOUND_ARROW, [a, b, *(pa.nulls(len(a), kind) for kind in _ROWS.values())])

    def border(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in rows.combine_chunks().to_batches():
            none = pa.nulls(len(batch), pa.int64())
            yield batch_of(_FOUND_ARROW, [none, none, *(batch.column(c).cast(k) for c, k in _ROWS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, n = None, None, 0
        for batch in batches:
            if not len(batch):
                continue
            if n < 2:
                yield from border(pa.Table.from_batches([batch.slice(0, 2 - n)]))
            # Rows that are among the first two are not listed again among the last.
            later = pa.Table.from_batches([batch.slice(max(0, 2 - n))])
            last = later if last is None else pa.concat_tables([last, later])
            last = last.slice(max(0, len(last) - 2))
            n += len(batch)
            new = (
                batch.column("tree").to_numpy(),
                _wide(batch.column("path"), ">u4"),
                batch.column("node").to_numpy(),
                batch.column("component").to_numpy(),
                batch.column("n_shingles").to_numpy().astype(float),
                _wide(batch.column("sketch"), "<u8"),
            )
            old = 0 if held is None else len(held[0])
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            tree, path, node, component, sizes, bits = held
            same = (path[1:, :enough] == path[:-1, :enough]).all(axis=1) & (tree[1:] == tree[:-1])
            left = np.flatnonzero(same & (component[1:] != component[:-1]))
            left = left[left + 1 >= old]
            near = ~far_apart(bits[left], bits[left + 1], sizes[left], sizes[left + 1], similarity / 100)
            a, b = node[left[near]], node[left[near] + 1]
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield links(pair[:, 0], pair[:, 1])
            far = np.flatnonzero(same[1:] & same[:-1])
            far = far[far + 2 >= old]
            marked = np.unique(np.concatenate((node[far], node[far + 2])))
            yield links(marked, pa.nulls(len(marked), pa.int64()))
            held = tuple(x[-2:] for x in held)
        if last is not None:
            yield from border(last)

    return run


_SETS = "node long, fine binary, found binary"
_SETS_ARROW = pa.schema([("node", pa.int64()), ("fine", pa.binary()), ("found", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(text).tobytes() for text in as_bytes(batch.column("text"))]
        yield batch_of(_SETS_ARROW, [batch.column("node"), batch.column("fine"), found])


def _signed_again(nth: int):
    """Paths of sets in the trees of a further round."""
    schema = pa.schema(
        [(c, pa.int64()) for c in ("node", "component", "n_shingles")] + [("paths", pa.binary()), ("coarse", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(f, np.uint64) for f in batch.column("found").to_pylist()]
            paths = [signature(f, nth).astype(">u4").tobytes() for f in found]
            columns = [list(map(len, found)), paths, [sketch(f, COARSE) for f in found]]
            yield batch_of(schema, [batch.column("node"), batch.column("component"), *columns])

    return run


def _buckets(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets of a task have shingles in each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for data in batch.column("found").to_pylist():
            np.add.at(total, _buckets(np.frombuffer(data, np.uint64)), 1)
    held = np.flatnonzero(total)
    yield batch_of(pa.schema([("bucket", pa.int64()), ("n", pa.int64())]), [held, total[held]])


_FIRST = "shingle long, shard int, node long, component long, size long, room long, shorter boolean, longer boolean, fine binary"
_FIRST_ARROW = pa.schema(
    [("shingle", pa.int64()), ("shard", pa.int32())]
    + [(c, pa.int64()) for c in ("node", "component", "size", "room")]
    + [("shorter", pa.bool_()), ("longer", pa.bool_()), ("fine", pa.binary())]
)


def _first_shingles(counts, similarity: int):
    """The rarest shingles of every set, with how many there are from each on (``room``).

    The shorter of two sets needs more room than the longer. A frequent shingle is parted over shards:
    sets go to one of them, and those with room enough to be the shorter go to all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        usual = int(np.median(often[often > 0])) if often.any() else 0
        for batch in batches:
            parts, made = [], []
            for node, component, data in zip(*(batch.column(c).to_pylist() for c in ("node", "component", "found")), strict=True):
                found = np.frombuffer(data, np.uint64)
                size = len(found)
                n = often[_buckets(found)]
                order = np.lexsort((found, n))[: size + (-similarity * size // 100) + 1]
                first, n = found[order], n[order]
                room = size - np.arange(len(first))
                shorter = room * (100 + similarity) >= 2 * similarity * size
                shards = np.maximum(1, -(-(n - 4 * usual) // CROWD))
                own = (hash((node, size, data[:8])) & 0x7FFFFFFF) % shards
                times = np.where(shorter, shards, 1)
                at = np.repeat(np.arange(len(first)), times)
                shard = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                shard = np.where(shorter[at], shard, own[at])
                same = np.full(len(at), 1)
                made.append(len(at))
                parts.append(
                    (first[at].view(np.int64), shard.astype(np.int32), same * node, same * component, same * size,
                     room[at], shorter[at], shard == own[at])
                )
            if parts:
                fine = batch.column("fine").take(pa.array(np.repeat(np.arange(len(made)), made)))
                yield batch_of(_FIRST_ARROW, [*(np.concatenate(c) for c in zip(*parts, strict=True)), fine])

    return run


def _best_of(found: np.ndarray, alike: np.ndarray, component: np.ndarray) -> np.ndarray:
    """The pair (a, b) that looks most alike, of every two components."""
    order = np.lexsort((found[:, 1], found[:, 0], -alike, component[:, 1], component[:, 0]))
    component = component[order]
    return found[order][np.append(True, (component[1:] != component[:-1]).any(axis=1))[: len(order)]]


def _meeting(similarity: int, best: bool):
    """Pairs (a, b) of different components whose first shingles meet where they have room for the overlap.

    The finer sketches are compared here, so that a group gives out its likely links, not its pairs; with
    ``best``, only the likeliest one of every two components that a task has at hand.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shingle, shard, node, component, size, room, shorter, longer, fine = rows
        begins = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (shard[1:] != shard[:-1])))
        ends = np.append(begins[1:], len(shingle))
        mixed = np.minimum.reduceat(component, begins) < np.maximum.reduceat(component, begins)
        for begin, end in zip(begins[mixed], ends[mixed], strict=True):
            x = begin + np.flatnonzero(shorter[begin:end])
            y = begin + np.flatnonzero(longer[begin:end])
            step = max(1, STEP // max(1, len(y)))
            for part in (x[k : k + step, None] for k in range(0, len(x), step)):
                fits = (component[part] != component[y]) & (size[part] <= size[y])
                fits &= 100 * size[part] >= similarity * size[y]
                fits &= np.minimum(room[part], room[y]) * (100 + similarity) >= similarity * (size[part] + size[y])
                i, j = np.nonzero(fits)
                left, right = part[i, 0], y[j]
                for k in range(0, len(left), COMPARED):
                    p, q = left[k : k + COMPARED], right[k : k + COMPARED]
                    sides = fine[p], fine[q], size[p].astype(float), size[q].astype(float), similarity / 100
                    near = ~far_apart(*sides)
                    p, q, alike = p[near], q[near], likeness(*sides)[0][near] if best else np.empty(0)
                    ends = np.sort(np.stack([node[p], node[q]], axis=1), axis=1)
                    yield ends, alike, np.sort(np.stack([component[p], component[q]], axis=1), axis=1)

    def out(parts: list) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def batch() -> pa.RecordBatch:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            found = _best_of(*whole) if best else np.unique(whole[0], axis=0)
            return batch_of(schema, [found[:, 0], found[:, 1]])

        for found in pairs(tuple(np.concatenate(c) for c in zip(*parts, strict=True))):
            held.append(found)
            n += len(found[0])
            if n > STEP:
                yield batch()
                held, n = [], 0
        if n:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            if not len(batch):
                continue
            plain = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in _FIRST_ARROW.names[:-1])
            rows = (*plain, _wide(batch.column("fine"), "<u8"))
            # Up to the last shingle of the batch all are complete.
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            begin = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if begin or parts and (parts[-1][0][-1], parts[-1][1][-1]) != (rows[0][0], rows[1][0]):
                if begin:
                    parts.append(tuple(c[:begin] for c in rows))
                yield from out(parts)
                parts = []
            parts.append(tuple(c[begin:] for c in rows))
        if parts:
            yield from out(parts)

    return run


def _confirmed(similarity: int):
    """Links whose full sets are as similar as asked, in hundredths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                sets = [[shingles(t.encode()) for t in side] for side in (left, right)]
                keep.append(any(_similar(x, y, similarity) for x in sets[0] for y in sets[1]))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield part.select(["a", "b"])

    return run


def _confirmed_sets(similarity: int):
    """Links whose sets, which come with them, are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(f, np.uint64) for f in batch.column(c).to_pylist()] for c in ("left", "right")]
            keep = [_similar(x, y, similarity) for x, y in zip(*sides, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _confirm_sets(sets: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of marked classes that are links, judged on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("found").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("found").alias("right"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return met.mapInArrow(_confirmed_sets(similarity), "a long, b long").distinct()


def _similar(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)) or not len(x):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= similarity * (len(x) + len(y) - both)


def _confirm(docs: DataFrame, pairs: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) that are links, judged on the whole texts of both."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("end"))
    texts = docs.select(F.col("doc_id").cast("long").alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda end: F.collect_set(F.when(F.col("end") == F.col(end), F.col("text")))
    return (
        # Neither side has a bound, so both are dealt by the end's identifier.
        ends.hint("merge").join(texts, "end")
        .groupBy("a", "b").agg(side("a").alias("left"), side("b").alias("right"))
        .mapInArrow(_confirmed(similarity), "a long, b long")
    )


def _next_ones(classes: DataFrame, similarity: int) -> DataFrame:
    """The candidates (a, b) of a round's trees, and the marked classes (b null).

    Parts have no neighbours in common, so the rows at their borders, four of each at most,
    are gone through once more. What is not next to each other there only adds candidates.
    """
    step = DEPTH * 4
    paths = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.col("paths").substr(k * step + 1, F.lit(step))
    )
    forest = classes.select(
        "node", "component", "n_shingles", F.col("coarse").alias("sketch"), F.posexplode(paths).alias("tree", "path")
    )
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "path", "node"]
    found = written(
        forest.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(similarity), _FOUND),
        "neighbours",
    )
    borders = found.filter("a is null").select(*_ROWS)
    across = borders.repartition(1).sortWithinPartitions(*order).mapInArrow(_neighbours(similarity), _FOUND)
    return found.unionByName(across).filter("a is not null").select("a", "b").distinct()


def _all_near(sets: DataFrame, similarity: int, best: bool = False) -> DataFrame:
    """The distinct candidates (a, b) of different components among all sets, without a limit; or the best of them."""
    spark = sets.sparkSession
    totals = sets.mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[totals.column("bucket").to_numpy()] = totals.column("n").to_numpy()
    return (
        sets.mapInArrow(_first_shingles(spark.sparkContext.broadcast(counts), similarity), _FIRST)
        .repartition("shingle", "shard").sortWithinPartitions("shingle", "shard")
        .mapInArrow(_meeting(similarity, best), "a long, b long")
        .distinct()
    )


def _joined(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with the least component that is at most two of the links from theirs.

    What gets one component is in one component; what is farther apart is joined in the end.
    """
    side = lambda c, name: labelled.select(F.col("node").alias(c), F.col("component").alias(name))
    met = links.join(side("a", "u"), "a").join(side("b", "v"), "b").filter("u <> v").select("u", "v").distinct()
    met = written(met.unionByName(met.select(F.col("v").alias("u"), F.col("u").alias("v"))), "met")
    one = met.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    two = met.join(one.select(F.col("u").alias("v"), "least"), "v").groupBy("u").agg(F.min("least").alias("least"))
    # The neighbour's least is at most the own component.
    found = labelled.join(two.select(F.col("u").alias("component"), "least"), "component", "left")
    return found.select("node", F.coalesce("least", "component").alias("component"))


def near_duplicates(docs: DataFrame, similarity: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; similarity is in hundredths."""
    spark = docs.sparkSession
    small_batches(spark)
    signed = written(
        docs.select("doc_id", "text").mapInArrow(
            _signed, "doc_id long, n_shingles long, digest binary, paths binary, coarse binary, fine binary"
        ),
        "signatures",
    )
    of_class = [F.first(c).alias(c) for c in ("n_shingles", "paths", "coarse", "fine")]
    classes = written(
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("digest").agg(F.min("doc_id").alias("node"), *of_class),
        "classes",
    )
    alone = classes.withColumn("component", F.col("node"))
    found = written(_next_ones(alone, similarity), "candidates")
    links = written(_confirm(docs, found.filter("b is not null"), similarity), "links")
    labels = written(components(links), "labels")
    marked = found.filter("b is null").select(F.col("a").alias("node"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(marked, "node")
    sets = written(
        texts.join(classes.select("node", "fine"), "node").select("node", "fine", "text").mapInArrow(_sets, _SETS)
        .filter(F.length("found") > 0),
        "sets",
    )

    labelled = sets.select("node").distinct().join(labels, "node", "left")
    labelled = written(labelled.select("node", F.coalesce("component", "node").alias("component")), "labelled")
    schema = "node long, component long, n_shingles long, paths binary, coarse binary"
    for nth in range(1, FURTHER + 1):
        again = written(sets.join(labelled, "node").mapInArrow(_signed_again(nth), schema), "signatures")
        found = _next_ones(again, similarity).filter("b is not null")
        more = written(_confirm_sets(sets, found, similarity), "links")
        links = links.unionByName(more)
        if more.isEmpty():
            break
        labelled = written(_joined(labelled, more), "labelled")
    # The likeliest link of every two components first: what it joins needs no other.
    found = written(_all_near(sets.join(labelled, "node"), similarity, best=True), "candidates")
    more = written(_confirm_sets(sets, found, similarity), "links")
    links, labelled = links.unionByName(more), written(_joined(labelled, more), "labelled")
    found = written(_all_near(sets.join(labelled, "node"), similarity), "candidates")
    links = written(links.unionByName(_confirm_sets(sets, found, similarity)), "links")
    labels = written(components(links), "labels")
    own = classes.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = signed.select("doc_id", "n_shingles", F.when(linked, F.col("digest")).alias("digest"))
    return rows.join(own, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("component", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def _id_key(doc_id: Column) -> Column:
    return doc_id.cast("string")


def keep_one(docs: DataFrame, similarity: int = 85) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns."""
    kept = near_duplicates(docs, similarity).filter("kept and doc_id is not null")
    named = only_once(docs.filter("doc_id is not null"), kept.select(_id_key(F.col("doc_id"))), _id_key(F.col("doc_id")))
    return named.unionByName(docs.filter("doc_id is null"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among ``documents``, at 85 hundredths."""
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id
GROUP BY s.doc_id, s.s
"""
