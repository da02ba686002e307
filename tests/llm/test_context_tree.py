import math
import tracemalloc
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from opsmill.llm import context_tree as ct
from opsmill.llm.common import crc_text, table
from pyspark.sql import functions as F

DEPTH = ct.DEPTH


def stream(text):
    return b" ".join((text or "").encode().lower().split())


def symbols(data):
    data = b"\n" * DEPTH + data + b"\n"
    for i in range(DEPTH, len(data)):
        for k in range(8):
            yield data[i - DEPTH : i], (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1


def brute(train):
    """Log10 probability by the recursion over contexts, node by node."""
    count = Counter()
    for text in train:
        for context, node, bit in symbols(stream(text)):
            for d in range(DEPTH + 1):
                count[context[DEPTH - d :], node, bit] += 1
    below = {}
    for context, node, _ in count:
        if context:
            below.setdefault((context[1:], node), set()).add(context)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(context, node):
        own = kt(count[context, node, 0], count[context, node, 1])
        if len(context) == DEPTH:
            return own
        rest = sum(weighted(c, node) for c in below.get((context, node), ()))
        top = max(own, rest)
        return top + math.log(math.exp(own - top) + math.exp(rest - top)) - math.log(2)

    def one(context, node, d=0):
        part = context[DEPTH - d :]
        a, b = count[part, node, 0], count[part, node, 1]
        if not a + b:
            return 0.5
        own = (b + 0.5) / (a + b + 1)
        if d == DEPTH:
            return own
        weight = math.exp(kt(a, b) - math.log(2) - weighted(part, node))
        return weight * own + (1 - weight) * one(context, node, d + 1)

    def score(text):
        total = 0.0
        for context, node, bit in symbols(stream(text)):
            p = one(context, node)
            total += math.log10(p if bit else 1 - p)
        return total

    return score


def cases(sentence):
    rows = [(k, sentence(3 + k % 9, 30)) for k in range(60)] + [(100 + k, "the Same copy") for k in range(20)]
    return rows + [(200, None), (201, ""), (202, " \t\n"), (203, "É é ñ 漢"), (None, "no id"), (5, rows[5][1]), (204, sentence(4000, 50))]


@pytest.mark.parametrize("chunk_bytes", [32 << 20, 500])
def test_against_brute_force(make_docs, sentence, chunk_bytes, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK_BYTES", chunk_bytes)
    monkeypatch.setattr(ct, "PART_BYTES", 5000)
    monkeypatch.setattr(ct, "HELD_KEYS", 500)
    rows = cases(sentence)
    out = {zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2: [] for i, _ in rows}
    for i, text in rows:
        out[zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2].append(text)
    tokens = Counter(w for t in out[False] for w in [*stream(t).split(), None])
    total, distinct = sum(tokens.values()), len(tokens)
    score = brute(out[False])
    found = ct.scored(make_docs(rows), crc_text(F.col("doc_id")) % 7 != 2).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        words = [*stream(text).split(), None]
        for r in by_id[i]:
            assert r.held_out == (zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2)
            assert (r.n_tokens, r.train_tokens) == (len(words), total)
            assert r.n_known == sum(tokens[w] > 0 for w in words)
            base = sum(math.log10((tokens[w] + 1) / (total + distinct + 1)) for w in words)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert r.score == pytest.approx(score(text), rel=1e-5)


def test_no_training_texts(make_docs):
    rows = ct.scored(make_docs([(1, "ab"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(1, 2, 0, 0), (2, 1, 0, 0)}
    assert {r.doc_id: r.score for r in rows} == pytest.approx({1: -24 * math.log10(2), 2: -8 * math.log10(2)})
    assert ct.scored(make_docs([]), F.lit(True)).collect() == []


def test_better_than_the_base_on_held_out_texts(spark):
    rows = ct.op6(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]
    assert table(spark, "/root/testdata/sf0.1", "documents").count() == 10_000


def test_a_word_is_hashed_once_for_a_group_of_texts(monkeypatch):
    words = [b"%x" % k for k in range(320_000)]
    streams, train = [b" ".join(words), b"", b" ".join(reversed(words))], [True, True, False]
    hashed, digest = [], ct.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(ct, "xxhash", type("Counted", (), {"xxh3_64_intdigest": staticmethod(lambda w: hashed.append(w) or digest(w))}))
    held = ct._Gathered()
    for stream_, own in zip(streams, train, strict=True):
        held.add([stream_], [own])
    keys, counts = held.result()
    assert len(hashed) <= len(words) + 1
    assert dict(zip(keys.tolist(), counts.tolist()))[-1] == 2
    assert counts[keys < -1].tolist() == [1] * len(words)


def test_a_chunk_takes_memory_for_a_part_and_its_keys(sentence, monkeypatch):
    monkeypatch.setattr(ct, "PART_BYTES", 400_000)
    monkeypatch.setattr(ct, "HELD_KEYS", 300_000)
    parts = [[sentence(2000, 10_000).encode() for _ in range(4)] for _ in range(40)]

    def peak(run):
        run()  # what is imported at the first call
        tracemalloc.start()
        found = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found, most

    def gathered():
        held = ct._Gathered()
        for part in parts:
            held.add(part, [True, False, True, True])
        return held.result()

    (keys, counts), most = peak(gathered)
    count = Counter(ct._sequences([s for part in parts for s in part])[0].tolist())
    own = Counter(ct._sequences([s for part in parts for s in part[:1] + part[2:]])[0].tolist())
    assert dict(zip(keys[keys >= 0].tolist(), counts[keys >= 0].tolist())) == {k: own[k] for k in count}
    assert counts[keys < 0].sum() == 40 * 3 * 2001
    # Codes of 8 bytes, keys and counts of 12 that are held and summed, and what the words take.
    assert most < 10 * ct.PART_BYTES + 25 * ct.HELD_KEYS + 5_000_000
    (own_keys, _), most = peak(lambda: ct._chunk_keys(iter(parts)))
    assert own_keys.tolist() == keys.tolist()
    assert most < 10 * ct.PART_BYTES + 25 * ct.HELD_KEYS + 5_000_000
