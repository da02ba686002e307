"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a tree of contexts, the bytes before
it, up to ``DEPTH`` of them. Every node mixes its own Krichevsky-Trofimov estimate with
what its children predict, by the weights that the training texts give it; the code length
of a text is the sum over its decisions, mixed over all depths. A text is its words, lower-cased,
with one space between and a line end, so that it says what the base model's tokens say.

Counts cover all training texts. Documents are dealt into chunks of bounded size as they
are read; a chunk sums its distinct byte sequences and words before anything moves, and
packs them by hash into as many buckets as there are chunks. A bucket so holds as much as a
chunk, and even the commonest word has one entry for each chunk. Contexts are dealt by
their two nearest bytes, so that each task has whole subtrees; only the nodes above (one
byte or none, at most 65,536) go through the driver. Each chunk then gets the values of
just the sequences and words that it holds, in the order of its own keys, and scores its
documents.

The base score adds one to every word's count; its counts are exact, by 63-bit hash.

Defined cases: null and empty texts are the end token alone; without training texts every
decision is even and no token is known; repeated rows are counted and scored each; a null
identifier counts as empty text in the hash that picks held-out rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.llm.common import as_bytes, batch_of, crc_text, small_batches, table, written

DEPTH = 6
CHUNK_BYTES = 32 << 20
#: Bytes that are sorted at a time, and keys that are held before they are summed.
PART_BYTES = 4 << 20
HELD_KEYS = 4_000_000
#: Ranges of keys that are summed one after another.
RANGES = 8
_START = b"\n" * DEPTH
#: The end token's key; words have smaller ones, byte sequences none below zero.
_END = -1
_DOC_BITS = np.uint64(64 - 8 * (DEPTH + 1))


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _parted(data: bytes) -> list[bytes]:
    """The texts of a row of a chunk."""
    return _opened(data).split(b"\n")


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers in rising order: their differences, by byte planes, compressed."""
    steps = np.diff(numbers.astype("<i8"), prepend=0).view("<u8")
    return _packed(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_opened(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64).view(np.int64)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in normal form, in chunks of bounded size; a row holds a few documents of one chunk."""
    number, held = TaskContext.get().partitionId() << 32, 0
    rows: list[tuple] = []
    size, schema = 0, None

    def out() -> pa.RecordBatch:
        ids, train, streams = zip(*rows, strict=True)
        return batch_of(schema, [[number], [list(ids)], [list(train)], [_packed(b"\n".join(streams))]])

    for batch in batches:
        schema = pa.schema(
            [("chunk", pa.int64()), ("ids", pa.list_(batch.schema.field("doc_id").type)), ("train", pa.list_(pa.bool_())), ("data", pa.binary())]
        )
        columns = (batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), as_bytes(batch.column("text")))
        for doc_id, train, text in zip(*columns, strict=True):
            stream = b" ".join(text.lower().split())
            full = held and held + len(stream) > CHUNK_BYTES
            if rows and (full or len(rows) >= 1 << int(_DOC_BITS) or size + len(stream) > PART_BYTES):
                yield out()
                rows, size = [], 0
            if full:
                number, held = number + 1, 0
            rows.append((doc_id, train, stream))
            size += len(stream)
            held += len(stream) + 1
    if rows:
        yield out()


def _sequences(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code of every byte with its context, over a few texts, and how many each text has."""
    # Each text begins in the start context, which is also what ends the one before it.
    data = np.frombuffer(b"".join(_START + s + b"\n" for s in streams), np.uint8)
    pair = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    four = pair[:-2].astype(np.uint32) << np.uint32(16) | pair[2:]
    code = four[:-3].astype(np.uint64) << np.uint64(24)
    code |= pair[4:-1].astype(np.uint32) << np.uint32(8) | data[DEPTH:]
    sizes = np.array([len(s) + 1 for s in streams])
    inside = np.ones(len(code), bool)
    inside[(np.cumsum(sizes + DEPTH)[:-1, None] - 1 - np.arange(DEPTH)).ravel()] = False
    return code[inside], sizes


def _sorted_codes(parts: list[list[bytes]], train: list[list[bool]] | None = None) -> np.ndarray:
    """Codes of all texts of a few parts, in order; with ``train``, its bit comes last in each.

    They are made part by part and sorted where they are, so that they are held once.
    """
    out, end = np.empty(_size(parts), np.uint64), 0
    for number, part in enumerate(parts):
        code, sizes = _sequences(part)
        if train:
            code <<= np.uint64(1)
            code |= np.repeat(np.array(train[number], bool), sizes)
        out[end : end + len(code)] = code
        end += len(code)
    out.sort()
    return out


def _size(parts: list[list[bytes]]) -> int:
    return sum(len(stream) + 1 for part in parts for stream in part)


def _words(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Negative keys of the distinct words of some texts, the place of every word among them, and where each text begins.

    A text without words has the one word ``_END``.
    """
    data = b"\n".join(streams) + b"\n"
    flat = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((flat == 10) | (flat == 32))
    borders = pa.py_buffer(np.append(0, ends + 1).astype(np.int32))
    # Words stand one blank apart; each is taken with the blank behind it.
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, borders, pa.py_buffer(data.replace(b"\n", b" "))])
    coded = words.dictionary_encode()
    # The distinct words follow each other, with their blanks.
    _, borders, letters = coded.dictionary.buffers()
    distinct = letters[: np.frombuffer(borders, np.int32)[len(coded.dictionary)]].to_pybytes().split(b" ")[:-1]
    digests = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    keys = -2 - ((digests >> np.uint64(1)) % np.uint64(2**63 - 2)).astype(np.int64)
    if b"" in distinct:
        keys[distinct.index(b"")] = _END
    starts = np.append(0, np.flatnonzero(flat[ends] == 10)[:-1] + 1)
    return keys, coded.indices.to_numpy(), starts


def _firsts(numbers: np.ndarray) -> np.ndarray:
    """Where each of the distinct numbers begins in a sorted array."""
    return np.flatnonzero(np.append(len(numbers) > 0, numbers[1:] != numbers[:-1]))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    counts = counts[order]
    del order
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts, first, dtype=counts.dtype) if len(first) else counts


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of sorted runs of keys, by ranges of keys, so that only one range is held a second time; the runs are given up."""
    longest = max(keys, key=len)
    borders = longest[len(longest) * np.arange(1, RANGES) // RANGES] if len(longest) else longest
    cuts = [[0, *np.searchsorted(k, borders), len(k)] for k in keys]
    sums = []
    for r in range(len(borders) + 1):
        own, n = ([x[c[r] : c[r + 1]] for x, c in zip(runs, cuts, strict=True)] for runs in (keys, counts))
        sums.append(_summed(np.concatenate(own), np.concatenate(n)))
    del own, n, longest
    keys.clear()
    counts.clear()
    return np.concatenate([k for k, _ in sums]), np.concatenate([n for _, n in sums])


class _Gathered:
    """Training counts of the distinct sequences and words of a chunk."""

    def __init__(self) -> None:
        self.keys, self.counts = [], []
        self.parts, self.train = [], []
        self.size = 0

    def add(self, streams: list[bytes], train: list[bool]) -> None:
        """Adds a few texts."""
        size = _size([streams])
        if self.size + size > PART_BYTES:
            self._count()
        self.parts.append(streams)
        self.train.append(train)
        self.size += size

    def _count(self) -> None:
        if not self.parts:
            return
        code = _sorted_codes(self.parts, self.train)
        n = np.empty(len(code), bool)
        np.bitwise_and(code, np.uint64(1), out=n, casting="unsafe")
        code >>= np.uint64(1)
        first = _firsts(code)
        counts = np.add.reduceat(n, first, dtype=np.uint32)
        code = code[first]
        del n, first
        self._hold(code.view(np.int64), counts)
        keys, at, starts = _words([stream for part in self.parts for stream in part])
        train = np.array([own for part in self.train for own in part])
        counts = np.bincount(at[np.repeat(train, np.diff(np.append(starts, len(at))))], minlength=len(keys))
        # Every text has one end beside its words.
        counts[keys == _END] = 0
        self._hold(*_summed(np.append(keys, _END), np.append(counts, train.sum()).astype(np.uint32)))
        self.parts, self.train, self.size = [], [], 0

    def _hold(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if sum(map(len, self.keys)) + len(keys) > HELD_KEYS and len(self.keys) > 1:
            self._sum()
        self.keys.append(keys)
        self.counts.append(counts)

    def _sum(self) -> None:
        keys, counts = _merged(self.keys, self.counts)
        self.keys, self.counts = [keys], [counts]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._count()
        self._sum()
        return self.keys[0], self.counts[0]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    # Sequences of one beginning stay together, so that their differences are small.
    mixed = np.where(keys < 0, keys, keys >> 16).view(np.uint64)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed %= np.uint64(buckets)
    return mixed.view(np.int64)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of sorted keys by bucket, the buckets that occur, and where each begins in it."""
    bucket = _bucket(keys, buckets).astype(np.min_scalar_type(buckets))
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = _firsts(bucket)
    return order, bucket[first].astype(np.int64), first


def _gather(buckets: int):
    """Packs of a chunk's keys, sorted, and their counts, by bucket."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def out(chunk: int, held: _Gathered) -> pa.RecordBatch:
        keys, counts = held.result()
        order, found, first = _by_bucket(keys, buckets)
        places = np.split(order, first[1:])
        keys = [_pack(keys[own]) for own in places]
        counts = [_packed(counts[own].astype("<u4").tobytes()) for own in places]
        return batch_of(schema, [np.full(len(found), chunk), found, keys, counts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, _Gathered()
        for batch in batches:
            rows = zip(batch.column("chunk").to_pylist(), batch.column("train"), batch.column("data"), strict=True)
            for chunk, train, data in rows:
                if chunk != current and current is not None:
                    yield out(current, held)
                    held = _Gathered()
                current = chunk
                held.add(_parted(data.as_py()), train.as_py())
        if current is not None:
            yield out(current, held)

    return run


def _unpacked(packs: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each pack, the distinct keys of all, their counts, and each entry's place among them."""
    keys = [_unpack(k) for k in packs.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(_opened(c), "<u4") for c in packs.column("counts").to_pylist()])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, distinct, np.bincount(at, counts, len(distinct)), at


def _bucket_sums(packs: pa.Table) -> pa.Table:
    """Counts of the sequences of a bucket; at -1 and -2 its training tokens and how many are distinct."""
    _, keys, counts, _ = _unpacked(packs)
    split = int(np.searchsorted(keys, 0))
    words = counts[:split]
    return pa.table(
        {
            "key": pa.array(np.concatenate((keys[split:], [-1, -2])), pa.int64()),
            "n": pa.array(np.concatenate((counts[split:], [words.sum(), (words > 0).sum()])).astype(np.int64), pa.int64()),
        }
    )


def _answers(packs: pa.Table, known: pa.Table) -> pa.Table:
    """Each chunk's word counts and sequence values of a bucket, in the order of its keys."""
    keys, distinct, counts, at = _unpacked(packs)
    split = int(np.searchsorted(distinct, 0))
    own, values = known.column("key").to_numpy(), known.column("value").to_numpy()
    answer = np.concatenate((counts[:split], values[np.argsort(own)]))
    # Two tasks may have read parts of one chunk: its keys are those of both.
    ends = np.cumsum([len(k) for k in keys])
    places: dict[int, list[np.ndarray]] = {}
    for chunk, k, end in zip(packs.column("chunk").to_pylist(), keys, ends, strict=True):
        places.setdefault(chunk, []).append(at[end - len(k) : end])
    words, logs = [], []
    for parts in places.values():
        place = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        border = int(np.searchsorted(place, split))
        words.append(_packed(answer[place[:border]].astype("<i8").tobytes()))
        logs.append(_packed(answer[place[border:]].astype("<f4").tobytes()))
    return pa.table(
        {
            "chunk": pa.array(list(places), pa.int64()),
            "bucket": pa.array([packs.column("bucket")[0].as_py()] * len(places), pa.int64()),
            "words": pa.array(words, pa.binary()), "logs": pa.array(logs, pa.binary()),
        }
    )


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving the argument up by eight."""
    y = x + 8
    shift = sum(np.log(x + k) for k in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def _mask(bits: int) -> np.int64:
    return np.int64((1 << bits) - 1)


def _decisions(codes: np.ndarray) -> list[np.ndarray]:
    """For each of the eight bits, context and bits so far including it (2 to 511), in one number."""
    context, byte = codes >> 8, codes & 255
    return [context << 9 | 2 << k | byte >> (7 - k) for k in range(8)]


class Subtrees:
    """The nodes of two bytes and more of context below some sequences."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        steps = np.concatenate(_decisions(codes))
        steps, n = _summed(steps, np.tile(counts, 8))
        self.nodes, self.zeros, self.ones = {}, {}, {}
        for depth in range(DEPTH, 1, -1):
            if depth < DEPTH:
                steps, n = _summed(steps & _mask(8 * depth + 9), n)
            node, at = np.unique(steps >> 1, return_inverse=True)
            one = steps & 1 == 1
            self.nodes[depth] = node
            self.zeros[depth] = np.bincount(at[~one], n[~one], len(node))
            self.ones[depth] = np.bincount(at[one], n[one], len(node))
        self.own = {}
        below = None
        for depth in range(DEPTH, 1, -1):
            kt = _kt(self.zeros[depth], self.ones[depth])
            if below is None:
                self.own[depth], total = np.ones(len(kt)), kt
            else:
                child = np.bincount(self.parents(depth + 1), below, len(kt))
                total = np.logaddexp(kt, child) - np.log(2)
                self.own[depth] = np.exp(kt - np.log(2) - total)
            below = total
        self.total = below  # logarithm of the weighted probability of the nodes of two bytes

    def parents(self, depth: int) -> np.ndarray:
        return np.searchsorted(self.nodes[depth - 1], self.nodes[depth] & _mask(8 * depth))

    def log10(self, codes: np.ndarray, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each sequence's last byte.

        ``mixed`` and ``left``, by byte and bits so far: what the shorter contexts give
        a one, and the weight they leave to the longer ones.
        """
        for depth in range(2, DEPTH + 1):
            if depth == 2:
                top = self.nodes[2] & _mask(16)
                s, r = mixed[top], left[top]
            else:
                up = self.parents(depth)
                s, r = s[up], r[up]
            one = (self.ones[depth] + 0.5) / (self.zeros[depth] + self.ones[depth] + 1)
            s, r = s + r * self.own[depth] * one, r * (1 - self.own[depth])
        out = np.zeros(len(codes))
        for step in _decisions(codes):
            p = s[np.searchsorted(self.nodes[DEPTH], step >> 1)]
            out += np.log10(np.where(step & 1 == 1, p, 1 - p))
        return out


def _top(pairs: np.ndarray, counts: np.ndarray, nodes: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What contexts of one byte and none give and leave, by byte and bits so far."""
    zeros, ones = np.zeros(65536), np.zeros(65536)
    for step in _decisions(pairs):
        one = step & 1 == 1
        np.add.at(ones, step[one] >> 1, counts[one])
        np.add.at(zeros, step[~one] >> 1, counts[~one])
    below = np.zeros(65536)
    below[nodes] = totals
    kt = _kt(zeros, ones)
    total = np.logaddexp(kt, below) - np.log(2)
    own1 = np.exp(kt - np.log(2) - total)
    zeros0, ones0 = zeros.reshape(256, 256).sum(axis=0), ones.reshape(256, 256).sum(axis=0)
    kt0 = _kt(zeros0, ones0)
    total0 = np.logaddexp(kt0, total.reshape(256, 256).sum(axis=0)) - np.log(2)
    own0 = np.exp(kt0 - np.log(2) - total0)
    mixed0 = np.tile(own0 * (ones0 + 0.5) / (zeros0 + ones0 + 1), 256)
    left0 = np.tile(1 - own0, 256)
    mixed = mixed0 + left0 * own1 * (ones + 0.5) / (zeros + ones + 1)
    return mixed, left0 * (1 - own1)


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    found = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts = _whole(batches)
    if len(codes):
        tree = Subtrees(codes, counts)
        node, at = np.unique(tree.nodes[2] & _mask(16), return_inverse=True)
        schema = pa.schema([("node", pa.int64()), ("total", pa.float64())])
        yield batch_of(schema, [node, np.bincount(at, tree.total, len(node))])


def _values(top: tuple[np.ndarray, np.ndarray], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = _whole(batches)
        if len(codes):
            schema = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("value", pa.float64())])
            yield batch_of(schema, [_bucket(codes, buckets), codes, Subtrees(codes, counts).log10(codes, *top)])

    return run


def sequence_values(sequences: DataFrame, buckets: int) -> DataFrame:
    """bucket, key and value: the model's log10 probability of the last byte of every sequence."""
    near = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    # At most 65,536 rows each.
    pairs = sequences.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect()
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sequences.repartition(parts, near)
    totals = dealt.mapInArrow(_totals, "node long, total double").groupBy("node").agg(F.sum("total").alias("total")).collect()
    top = _top(
        np.array([r["pair"] for r in pairs], np.int64), np.array([r["n"] for r in pairs], float),
        np.array([r["node"] for r in totals], np.int64), np.array([r["total"] for r in totals], float),
    )
    return dealt.mapInArrow(_values(top, buckets), "bucket long, key long, value double")


def _chunk_keys(parts: Iterator[list[bytes]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The distinct keys of a chunk as ``_Gathered`` has them, and its words by groups of parts."""
    keys, words, held, size = [np.array([_END])], [], [], 0

    def close() -> None:
        code = _sorted_codes(held)
        code = code[_firsts(code)].view(np.int64)
        words.append(_words([stream for part in held for stream in part]))
        held.clear()
        for own in (code, words[-1][0]):
            if sum(map(len, keys)) + len(own) > HELD_KEYS and len(keys) > 1:
                keys.append(_distinct(keys))
            keys.append(own)

    for part in parts:
        if held and size + _size([part]) > PART_BYTES:
            close()
            size = 0
        held.append(part)
        size += _size([part])
    close()
    return _distinct(keys), words


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers of the parts, in order; the parts are given up, so that nothing is held twice."""
    both = np.concatenate(parts)
    parts.clear()
    both.sort()
    return both[_firsts(both)]


def _scorer(buckets: int, total: int, distinct: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, train, packed = (texts.column(c).to_pylist() for c in ("ids", "train", "data"))
        # The texts are opened twice, a part at a time, so that a chunk is not held in full.
        keys, words = _chunk_keys(map(_parted, packed))
        order, found, first = _by_bucket(keys, buckets)
        rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "words", "logs")), strict=True))
        if [r[0] for r in rows] != found.tolist():
            raise ValueError("a chunk's answers are not for its keys")
        # Words come first among the keys and in each pack.
        split = int(np.searchsorted(keys, 0))
        word_counts, logs = np.empty(split), np.empty(len(keys) - split, np.float32)
        ends = np.append(first[1:], len(keys))
        for row, begin, end in zip(rows, first, ends, strict=True):
            border = begin + int(np.searchsorted(order[begin:end], split))
            word_counts[order[begin:border]] = np.frombuffer(_opened(row[1]), "<i8")
            logs[order[border:end] - split] = np.frombuffer(_opened(row[2]), "<f4")
        del order, rows
        word_keys, sequence_keys = keys[:split], keys[split:]
        base_logs = np.log10((word_counts + 1) / (total + distinct + 1))
        columns = {name: [] for name in ("n_tokens", "n_known", "base_score", "score")}
        for part in map(_parted, packed):
            code, sizes = _sequences(part)
            code <<= _DOC_BITS
            code |= np.repeat(np.arange(len(part), dtype=np.uint8), sizes)
            code.sort()
            whose = code.astype(np.uint8)
            code >>= _DOC_BITS
            first = _firsts(code)
            at = np.searchsorted(sequence_keys, code[first].view(np.int64))
            value = np.repeat(logs[at].astype(float), np.diff(np.append(first, len(code))))
            columns["score"].append(np.bincount(whose, value, len(part)))
        for own, at, starts in words:
            place, is_word = np.searchsorted(word_keys, own), own != _END
            # Every text has one end beside its words; the end's key is the largest of the words'.
            for name, value, end in (
                ("n_tokens", is_word, 1),
                ("n_known", is_word & (word_counts[place] > 0), word_counts[-1] > 0),
                ("base_score", np.where(is_word, base_logs[place], 0), base_logs[-1]),
            ):
                value = value if name == "base_score" else value.astype(np.int64)
                columns[name].append(np.add.reduceat(value[at], starts) + end)
        out = {name: np.concatenate(values) for name, values in columns.items()}
        train = [t for own in train for t in own]
        return pa.table(
            {
                "doc_id": pa.array([i for own in ids for i in own], texts.schema.field("ids").type.value_type),
                "held_out": pa.array([not t for t in train], pa.bool_()),
                "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                "n_known": pa.array(out["n_known"], pa.int64()),
                "train_tokens": pa.array(np.full(len(train), total), pa.int64()),
                "base_score": pa.array(out["base_score"], pa.float64()),
                "score": pa.array(out["score"], pa.float64()),
            }
        )

    return run


def scored(docs: DataFrame, train: Column) -> DataFrame:
    """Scores of all texts by a model of those for which the column ``train`` holds."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = written(
        docs.select("doc_id", "text", train.alias("train")).mapInArrow(
            _chunked, f"chunk long, ids array<{id_type}>, train array<boolean>, data binary"
        ),
        "texts",
    )
    buckets = max(12, texts.select("chunk").distinct().count())
    packs = written(
        texts.select("chunk", "train", "data").mapInArrow(
            _gather(buckets), "chunk long, bucket long, keys binary, counts binary"
        ),
        "packs",
    )
    sums = written(packs.groupBy("bucket").applyInArrow(_bucket_sums, "key long, n long"), "sums")
    size = {r["key"]: r["n"] for r in sums.filter("key < 0").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    total, distinct = size.get(-1, 0), size.get(-2, 0)
    values = sequence_values(sums.filter("key >= 0"), buckets)
    answers = packs.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(
        _answers, "chunk long, bucket long, words binary, logs binary"
    )
    schema = (
        f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double"
    )
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _scorer(buckets, total, distinct), schema
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from six sevenths of them."""
    return scored(table(spark, sf_dir, "documents"), crc_text(F.col("doc_id")) % 7 != 2)
