"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token that is no token itself is a linked list of byte runs. The pre-tokens that a
worker meets for the first time in a batch share one queue: every pair of neighbours
whose joined bytes have a rank stands, by its position, in the bucket of that rank's word
of the bitmap, and a summary bit per word tells by find-first-set which bucket comes
next. Of that bucket each pre-token merges its lowest rank, the leftmost on a tie; the
others stay for the next round; entries whose pair has changed meanwhile are skipped. So
each pre-token sees exactly the order of its own ranks, and no step depends on how long
a pre-token is.

Pre-tokens are the matches of the public pattern, each encoded for itself, and no special
tokens are known. A worker remembers the ids of up to ``REMEMBERED`` different pre-tokens;
that only saves time. Documents are encoded in their rows, with no shuffle.

Defined cases: null or empty text has no ids and decodes to no bytes; repeated rows are
encoded each; other columns are not read. Any sequence of ids of the vocabulary decodes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm.common import batch_of, chunks, small_batches, table

REMEMBERED = 1_000_000
#: Documents that a worker takes at a time.
DOCUMENTS = 1024


#: Bytes of one queue.
QUEUE_BYTES = 1 << 19
#: A longer pre-token has a queue of its own, which merges one pair at a time.
LONG = 200
_NONE = 0xFFFFFFFF


class Vocabulary:
    """Ranks of byte strings, read from a file with a base64 string and a rank per line."""

    def __init__(self, lines: Iterable[bytes], pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        top = max(self.ranks.values()) + 1
        self.end = top  # stands where no token is
        pairs = {
            (left << 32 | right): rank
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if (left := self.ranks.get(token[:k])) is not None
            and (right := self.ranks.get(token[k:])) is not None
        }
        codes = np.array(sorted(pairs), np.uint64)
        self.codes = np.append(codes, np.uint64(2**64 - 1))
        self.merged = np.array([pairs[int(c)] for c in codes] + [_NONE], np.int64)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = {rank: token for token, rank in self.ranks.items()}
        self.lengths = np.array([len(tokens.get(k, b"")) for k in range(top)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens.get(k, b"") for k in range(top)), np.uint8)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.merged[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, packed as little-endian unsigned 32-bit integers."""
        # Every piece stands between two places that hold no token.
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        stops = np.cumsum(sizes + 1)
        ids = self.byte_ids[raw]
        ids[0] = ids[stops] = self.end
        owner = np.repeat(np.arange(len(pieces) + 1), np.append(sizes + 1, 1))
        after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        pair = np.append(self._pair(ids[:-1], ids[1:]), _NONE)
        buckets: dict[int, list[np.ndarray]] = {}
        summary = 0

        def push(positions: np.ndarray) -> int:
            words = pair[positions] >> 8
            order = np.argsort(words, kind="stable")
            words, positions = words[order], positions[order]
            cuts = np.flatnonzero(np.diff(words)) + 1
            filled = 0
            for word, group in zip(words[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                buckets.setdefault(word, []).append(group)
                filled |= 1 << word
            return filled

        first = np.flatnonzero(pair != _NONE)
        if len(first):
            summary = push(first)
        while summary:
            word = (summary & -summary).bit_length() - 1
            entries = buckets.pop(word)
            at = np.concatenate(entries) if len(entries) > 1 else entries[0]
            rank = pair[at]
            fresh = rank >> 8 == word
            at, rank = at[fresh], rank[fresh]
            summary &= ~(1 << word)
            if not len(at):
                continue
            # By pre-token, then rank, then position; a position that stands twice counts once.
            order = np.lexsort((at, rank, owner[at]))
            at = at[order]
            whose = owner[at]
            lead = np.append(True, whose[1:] != whose[:-1])
            rest, at = at[~lead], at[lead]
            if len(rest):
                buckets[word] = [rest]
                summary |= 1 << word
            ids[at] = pair[at]
            gone = after[at]
            stop = after[gone]
            after[at] = stop
            before[stop] = at
            pair[gone] = _NONE
            left = before[at]
            pair[at] = self._pair(ids[at], ids[stop])
            pair[left] = self._pair(ids[left], ids[at])
            changed = np.concatenate((at, left))
            changed = changed[pair[changed] != _NONE]
            if len(changed):
                summary |= push(changed)
        alive = np.ones(len(raw), bool)
        # A place is alive if the one before it leads to it.
        alive[1:] = after[before[1:]] == np.arange(1, len(raw))
        counts = np.add.reduceat(np.where(alive & (ids != self.end), 1, 0), np.append(0, stops[:-1]))
        packed = ids[alive & (ids != self.end)].astype("<u4").tobytes()
        cut = np.append(0, np.cumsum(counts) * 4).tolist()
        return [packed[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one pre-token of any length.

        ``buckets`` holds, by rank, the starts of the pairs of that rank, the leftmost
        first. ``bits`` maps a word of the bitmap to its bits, one for each rank that has
        entries, and ``summary`` has one bit for each word that is not empty.
        """
        get, n = self.ranks.get, len(piece)
        ends, before = list(range(1, n + 2)), list(range(-1, n))
        pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)
        buckets: dict[int, list[int]] = {}
        bits: dict[int, int] = {}
        summary = 0
        changed = list(enumerate(pair))
        while True:
            for start, new in changed:
                if new < 0:
                    continue
                if new in buckets:
                    heappush(buckets[new], start)
                else:
                    buckets[new] = [start]
                    word = new >> 8
                    bits[word] = bits.get(word, 0) | 1 << (new & 255)
                    summary |= 1 << word
            if not summary:
                break
            word = (summary & -summary).bit_length() - 1
            held = bits[word]
            rank = (word << 8) + (held & -held).bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bits[word] = held = held & (held - 1)
                if not held:
                    summary &= summary - 1
            changed = []
            if pair[i] != rank:
                continue  # the pair has changed since
            middle = ends[i]
            end = ends[i] = ends[middle]
            pair[middle] = pair[i] = -1
            if end < n:
                before[end] = i
                pair[i] = get(piece[i : ends[end]], -1)
                changed.append((i, pair[i]))
            left = before[i]
            if left >= 0:
                pair[left] = get(piece[left:end], -1)
                changed.append((left, pair[left]))
        ids, i = [], 0
        while i < n:
            ids.append(get(piece[i : ends[i]]))
            i = ends[i]
        return ids

    def learn(self, texts: list[list[str]]) -> dict[str, bytes]:
        """Ids of all pre-tokens of some texts, from memory or merged now."""
        known = self.known
        new = list(set().union(*texts) - known.keys())
        if len(known) + len(new) > REMEMBERED:
            known = self.known = {}
            new = list(set().union(*texts))
        todo = []
        for piece in new:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is None:
                todo.append((piece, raw))
            else:
                known[piece] = pack("<I", whole)
        for piece, raw in [p for p in todo if len(p[1]) > LONG]:
            ids = self.merge_long(raw)
            known[piece] = pack(f"<{len(ids)}I", *ids)
        todo = [p for p in todo if len(p[1]) <= LONG]
        for part in chunks(todo, QUEUE_BYTES, lambda p: len(p[1]) + 1):
            known.update(zip([p[0] for p in part], self.merge([p[1] for p in part]), strict=True))
        return known

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed."""
        out = []
        for part in chunks(texts, 8 << 20):
            pieces = list(map(self.split, part))
            known = self.learn(pieces).__getitem__
            out.extend(b"".join(map(known, p)) for p in pieces)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.data[shift + np.arange(len(shift))].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a worker, read once."""
    with open(path, "rb") as lines:
        return Vocabulary(lines, pattern)


def _rows(docs: DataFrame, names: list[str], make, out: T.StructType, arrow: pa.Schema) -> DataFrame:
    small_batches(docs.sparkSession, DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([pa.field("doc_id", batch.schema.field(0).type), *arrow])
            yield batch_of(schema, [batch.column(0), *make(batch.column(1).to_pylist())])

    schema = T.StructType([T.StructField("doc_id", docs.schema[names[0]].dataType), *out])
    return docs.select(*names).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of long) of every whole text."""

    def make(texts):
        packed = vocabulary(path, pattern).encode_all([t or "" for t in texts])
        return ([np.frombuffer(p, "<u4").astype("i8") for p in packed],)

    return _rows(
        docs, ["doc_id", "text"], make,
        T.StructType([T.StructField("ids", T.ArrayType(T.LongType()))]),
        pa.schema([("ids", pa.list_(pa.int64()))]),
    )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (bytes) of every sequence of ids; null ids decode to no bytes."""

    def make(rows):
        own = vocabulary(path, pattern)
        return ([own.decode(np.array(ids or [], np.int64)) for ids in rows],)

    return _rows(
        encoded, ["doc_id", "ids"], make,
        T.StructType([T.StructField("data", T.BinaryType())]),
        pa.schema([("data", pa.binary())]),
    )


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids."""

    def make(texts):
        own = vocabulary(path, pattern)
        packed = own.encode_all([t or "" for t in texts])
        data = (own.decode(np.frombuffer(p, "<u4")) for p in packed)
        return (
            [len(p) // 4 for p in packed],
            [hashlib.sha256(p).hexdigest() for p in packed],
            [hashlib.sha256(d).hexdigest() for d in data],
        )

    return _rows(
        docs, ["doc_id", "text"], make,
        T.StructType(
            [
                T.StructField("n_tokens", T.LongType(), False),
                T.StructField("ids_sha256", T.StringType(), False),
                T.StructField("decoded_sha256", T.StringType(), False),
            ]
        ),
        pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
    )


def multilingual(docs: DataFrame) -> DataFrame:
    """``round_trip`` with the installed public vocabulary for many languages."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text of ``documents`` and the bytes that they decode to, as digests."""
    return multilingual(table(spark, sf_dir, "documents"))
