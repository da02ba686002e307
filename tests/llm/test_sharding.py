import zlib
from itertools import pairwise

from opsmill.llm import sharding


def cases(sentence):
    rows = [(k, sentence(1 + k % 60)) for k in range(300)] + [(1000 + k, "hot copy") for k in range(150)]
    return rows + [(2000, None), (2001, ""), (None, "x"), (2002, "é" * 500), (5, rows[5][1])]


def test_law(spark, make_docs, sentence, tmp_path):
    rows = cases(sentence)
    folder = str(tmp_path / "in")
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    found = sharding.op9(spark, folder).collect()
    wanted = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == wanted
    shards = {}
    for r in found:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(24))
    target, largest = sum(r.size for r in found) / 24, max(r.size for r in found)
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r.size for r in members) - target) <= largest
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}


def test_shards_are_contiguous(spark, make_docs, sentence):
    rows = sharding.sized(make_docs(cases(sentence)))
    found = sharding.byte_shards(rows, ["doc_id", "size"], 7).collect()
    order = sorted(found, key=lambda r: (r.shard, r.slot))
    keys = [(r.doc_id is not None, r.doc_id or 0, r.size) for r in order]
    assert all(a <= b for a, b in pairwise(keys))


def test_few_rows(spark, make_docs):
    assert sharding.byte_shards(sharding.sized(make_docs([])), ["doc_id"]).collect() == []
    one = sharding.byte_shards(sharding.sized(make_docs([(1, "a")])), ["doc_id"]).collect()
    assert [(r.slot, 0 <= r.shard < 24) for r in one] == [(0, True)]
