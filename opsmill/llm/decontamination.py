"""Benchmark decontamination with a generalised suffix automaton over words.

One automaton holds the word sequences of all benchmark items. Documents stream
through it; at every word the automaton knows the longest suffix of the document that
occurs in some item. Where that length reaches the window, the last ``window`` words
are an occurrence; a short item counts where its whole sequence ends.

The items are collected in blocks of at most ``block_bytes`` of text, one automaton
per block, and only a block is ever broadcast. Documents are read once per block, row
by row, without a shuffle; with the usual single block nothing else happens.

Words are the runs of digits, letters and non-ASCII characters of the text with A-Z in
lower case. Defined cases: null or empty text has no words; an item without words
matches nothing; repeated items count as different items if their ids differ and once
if they don't; a null item id is ignored; repeated documents are judged one by one; an
empty benchmark leaves all documents clean; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm.common import as_bytes, batch_of, small_batches, table

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Slots of the table that tells quickly whether two words ever follow each other in an item.
_PAIR_BITS = 22

_WORDS = bytearray(b" " * 256)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _WORDS[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORDS[_c] = _c + 32
_WORDS[0x80:] = bytes(range(0x80, 0x100))
_WORDS = bytes(_WORDS)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class ItemAutomaton:
    """Generalised suffix automaton of the items' word sequences."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]
            if words:
                sequences.append((item, words))
                last = 0
                for w in words:
                    last = self._extend(last, w)
        self.shortest = min([window, *(len(words) for _, words in sequences)])
        self.names = sorted({item for item, _ in sequences})
        number = {item: k for k, item in enumerate(self.names)}
        #: Items by the state that their windows end in; the window's length if it is a short item.
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, set[int]]]] = {}
        for item, words in sequences:
            self._mark(words, number[item])
        self._inherit_short()
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        for _, words in sequences:
            w = np.array(words, np.int64)
            self.pairs[self._slot(w[:-1], w[1:])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a * 0x9E3779B1 + b * 0x85EBCA77) & 0xFFFFFFFF
        return (mixed ^ (mixed >> 15)) & ((1 << _PAIR_BITS) - 1)

    def _state(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state of the longest p-word string, apart from the longer ones of q."""
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _mark(self, words: list[int], item: int) -> None:
        state, size = 0, min(self.window, len(words))
        for k, w in enumerate(words):
            state = self.next[state][w]
            if k + 1 >= size:
                at = self._shortened(state, size)
                if size == self.window:
                    self.full.setdefault(at, set()).add(item)
                else:
                    self.short.setdefault(at, []).append((size, {item}))
                state = at if size == self.window else state

    def _shortened(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of what led to ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _inherit_short(self) -> None:
        """Let each state know all short items that end where it ends."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.short.get(self.link[state])
            if above:
                self.short.setdefault(state, []).extend(above)

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans that occur in items (start, end), and the items."""
        known = self.ids.get
        ids = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for start, end in self._stretches(ids):
            self._stream(ids[start:end].tolist(), start, found, items)
        return found, items

    def _stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where enough words stand in a row, each pair of which occurs in some item."""
        if not len(ids) or not self.ids:
            return []
        inside = (ids[:-1] >= 0) & (ids[1:] >= 0)
        inside[inside] = self.pairs[self._slot(ids[:-1][inside], ids[1:][inside])]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2] + 1
        if self.shortest == 1:  # words that stand alone count too
            alone = ids >= 0
            alone[:-1] &= ~inside
            alone[1:] &= ~inside
            lone = np.flatnonzero(alone)
            starts, ends = np.concatenate((starts, lone)), np.concatenate((ends, lone + 1))
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def _stream(self, ids: list[int], offset: int, found: list, items: set[int]) -> None:
        state = matched = 0
        step, link, length, window = self.next, self.link, self.length, self.window
        for k, w in enumerate(ids, offset + 1):
            while state and w not in step[state]:
                state = link[state]
                matched = length[state]
            if w in step[state]:
                state = step[state][w]
                matched += 1
            if matched >= window:
                # Strings longer than the window tell no more: go on with the window alone.
                while length[link[state]] >= window:
                    state = link[state]
                matched = window
                found.append((k - window, k))
                items |= self.full[state]
            for size, names in self.short.get(state, ()):
                if size <= matched:
                    found.append((k - size, k))
                    items |= names


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size; the driver never holds more than one block."""
    block, held = [], 0
    items = benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id is not null and text is not null")
    for item, text in items.toLocalIterator():
        raw = text.encode()
        if block and held + len(raw) > block_bytes:
            yield block
            block, held = [], 0
        block.append((item, raw))
        held += len(raw)
    if block:
        yield block


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType(), False), False), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
    ]
)
_FOUND_ARROW = [
    pa.field("n_words", pa.int64()),
    pa.field("spans", pa.list_(pa.list_(pa.int32()))),
    pa.field("items", pa.list_(pa.string())),
]


def find_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_words, spans (of words, merged) and items (sorted) of every document.

    With several blocks of items a document's findings are put together in its row: the
    pass over one block carries the findings of those before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("text", T.StringType()), *_FOUND])
    found = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    blocks = item_blocks(benchmark, block_bytes)
    block = next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(block)
        last = following is None

        def stream(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            automaton = ItemAutomaton(shared.value, window)
            for batch in batches:
                n_words, spans, items = [], [], []
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                for text, (old_spans, old_items) in zip(as_bytes(batch.column("text")), before, strict=True):
                    words = words_of(text)
                    new, hit = automaton.spans(words)
                    n_words.append(len(words))
                    spans.append(merged([*map(tuple, old_spans), *new]))
                    items.append(sorted({*old_items, *(automaton.names[k] for k in hit)}))
                text_out = pa.nulls(len(n_words), pa.string()) if last else batch.column("text")
                own = pa.schema([batch.schema.field("doc_id"), pa.field("text", pa.string()), *_FOUND_ARROW])
                yield batch_of(own, [batch.column("doc_id"), text_out, n_words, spans, items])

        found = found.mapInArrow(stream, schema)
        block = following
    return found.drop("text")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    n_hit = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return (
        find_spans(docs, benchmark, window)
        .withColumn("n_hit", n_hit)
        .select(
            "doc_id", "n_words", "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    raw = text.encode()
    plain = raw.translate(_WORDS)
    starts, ends, at = [], [], 0
    for word in plain.split():
        at = plain.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : starts[start]])
        at = ends[end - 1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_length: int = 0,
    max_coverage: float = 0.0,
) -> DataFrame:
    """``docs`` without benchmark passages, in the same columns.

    A document goes if its found spans cover more than ``max_coverage`` of its words.
    Of the others every span of more than ``max_length`` words is cut out of the text.
    With the defaults every contaminated document goes, since what remains of a
    document around a passage often tells the rest of it.
    """
    if max_coverage <= 0:
        return _filter_clean(docs, benchmark, window)
    return _cut(docs, benchmark, window, max_length, max_coverage)


def _each_block(docs: DataFrame, benchmark: DataFrame, make) -> DataFrame:
    """``docs`` through ``make(block, batches)`` for each block of items, one after another."""
    small_batches(docs.sparkSession)
    out = docs
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(lambda batches, shared=shared: make(shared.value, batches), docs.schema)
    return out


def _filter_clean(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    at = docs.columns.index("text")

    def clean(block, batches):
        automaton = ItemAutomaton(block, window)
        for batch in batches:
            keep = [not automaton.spans(words_of(t))[0] for t in as_bytes(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return _each_block(docs, benchmark, clean)


def _cut(docs: DataFrame, benchmark: DataFrame, window: int, max_length: int, max_coverage: float) -> DataFrame:
    at = docs.columns.index("text")

    def clean(block, batches):
        automaton = ItemAutomaton(block, window)
        for batch in batches:
            texts, keep = [], []
            for text in batch.column(at).to_pylist():
                words = words_of((text or "").encode())
                spans = merged(automaton.spans(words)[0])
                covered = sum(end - start for start, end in spans)
                keep.append(covered <= max_coverage * len(words))
                long = [s for s in spans if s[1] - s[0] > max_length]
                texts.append(cut_spans(text, long) if long else text)
            texts = pa.array(texts, batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts).filter(pa.array(keep, pa.bool_()))

    return _each_block(docs, benchmark, clean)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of ``documents`` hold windows of ``benchmark``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
    unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
                          lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win
  FROM item_words WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, s.n, item_id FROM starts s JOIN windows v ON v.n = s.n AND v.win = array_to_string(w[i:i + s.n - 1], ' ')
), places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
