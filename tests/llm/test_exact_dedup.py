import hashlib
from collections import defaultdict

from opsmill.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, keep):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = {}
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out[hashlib.sha256(text.encode()).hexdigest()] = (best, len(ids))
    return out


def cases(rng):
    rows = [(k, f"Text {k % 40}" if k % 3 else "HOT copy") for k in range(400)]
    rows += [(500, None), (501, ""), (502, "É"), (503, "é"), (504, "ABC"), (505, "abc"), (None, "abc"), (None, "alone")]
    rows += [(600, "same row"), (600, "same row"), (601, "x" * 200_000), (602, "X" * 200_000)]
    rng.shuffle(rows)
    return rows


def test_groups(make_docs, rng):
    rows = cases(rng)
    for keep in ("smallest", "largest"):
        for fan in (2, 8):
            found = exact_dedup.duplicate_groups(make_docs(rows), keep, fan).collect()
            wanted = brute(rows, keep)
            assert len(found) == len(rows)
            assert {r.text_sha256: (r.keep_id, r.group_size) for r in found} == wanted
            assert all((r.keep_id, r.group_size) == wanted[r.text_sha256] for r in found)
            kept = [r for r in found if r.kept]
            assert len(kept) == len(wanted) and all(r.doc_id == r.keep_id for r in kept)


def test_rows_that_stay(make_docs, rng):
    rows = cases(rng)
    docs = make_docs(rows)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    assert sorted((t or "").translate(LOWER) for _, t, *_ in left.collect()) == sorted({(t or "").translate(LOWER) for _, t in rows})


def test_empty(make_docs):
    assert exact_dedup.duplicate_groups(make_docs([])).collect() == []
    assert exact_dedup.drop_duplicates(make_docs([])).collect() == []
