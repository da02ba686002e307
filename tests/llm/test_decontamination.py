import re
from collections import defaultdict

from opsmill.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        if item is not None and size:
            for k in range(len(w) - size + 1):
                windows[tuple(w[k : k + size])].add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                names = windows.get(tuple(w[k : k + size]))
                if names:
                    hit |= set(range(k, k + size))
                    found |= names
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def found(docs, benchmark, window, block_bytes):
    rows = dc.find_spans(docs, benchmark, window, block_bytes).collect()
    return sorted(
        ((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), tuple(r["items"])) for r in rows), key=repr
    )


def test_against_brute_force(spark, make_docs, rng):
    few = lambda n, k: " ".join(rng.choice(["a", "B", "c", "é", "x1"][:k]) for _ in range(n))
    items = [(k, few(rng.choice([1, 2, 4, 5, 6, 12, 30]), 5)) for k in range(25)]
    items += [(90, None), (91, ""), (92, "?!"), (None, "a b c"), (3, items[3][1])]
    rows = [(k, few(rng.randrange(0, 60), rng.randrange(2, 6)) + rng.choice(["", " z ", "."])) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "..."), (203, few(20_000, 3)), (None, items[0][1]), (5, rows[5][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(rows)
    for window in (3, 5, 10):
        wanted = brute(rows, items, window)
        assert found(docs, benchmark, window, 4 << 20) == wanted
    assert found(docs, benchmark, 5, 60) == brute(rows, items, 5)  # many blocks
    assert found(docs, benchmark.filter("item_id < 0"), 5, 60) == brute(rows, [], 5)
    assert found(make_docs([]), benchmark, 5, 60) == []


def test_documents_without_passages(spark, make_docs, sentence):
    passage, clean = sentence(30), sentence(200, 100_000)
    rows = [(1, clean), (2, f"{clean} {passage}"), (3, passage), (4, None), (5, f"Keep this, {passage}! And that.")]
    docs = make_docs(rows)
    benchmark = spark.createDataFrame([(7, passage)], "item_id long, text string")
    left = dc.decontaminate(docs, benchmark)
    assert left.dtypes == docs.dtypes and sorted(r.doc_id for r in left.collect()) == [1, 4]
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, benchmark, max_coverage=0.95).collect()}
    assert sorted(cut) == [1, 2, 4, 5] and cut[5] == "Keep this, ! And that." and cut[2] == f"{clean} "
    kept = {r.doc_id: r.text for r in dc.decontaminate(docs, benchmark, max_length=30, max_coverage=1.0).collect()}
    assert kept[2] == rows[1][1]
