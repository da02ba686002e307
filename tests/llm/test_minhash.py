import re

import pytest

from opsmill.llm import minhash
from opsmill.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def union(pairs, ids):
    head = {i: i for i in ids}

    def top(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        head[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute(rows, similarity):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    pairs = [
        (i, j)
        for n, (i, x) in enumerate(sets)
        for j, y in sets[:n]
        if x and y and 100 * len(x & y) >= similarity * len(x | y)
    ]
    return union(pairs, {i for i, _ in sets})


def near(rng, words, share):
    return [f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def corpus(rng):
    rows, k = [], 0
    for _ in range(40):
        base = [f"b{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        for _ in range(rng.randrange(1, 8)):
            rows.append((k, " ".join(near(rng, base, rng.choice([0, 0.005, 0.02, 0.04])))))
            k += 1
    # A chain: neighbours are near, the ends are not.
    words = [f"c{n}" for n in range(200)]
    for step in range(12):
        rows.append((k, " ".join([f"new{n}" for n in range(step * 3)] + words[step * 3 :])))
        k += 1
    # A large group of near copies, many exact ones, and pages that share a passage.
    base = [f"g{n}" for n in range(150)]
    for _ in range(60):
        rows.append((k, " ".join(near(rng, base, 0.006))))
        k += 1
    rows += [(k + n, "One two THREE four five six") for n in range(50)]
    k += 50
    for n in range(60):
        rows.append((k, " ".join(base[:100] + [f"own{n}x{m}" for m in range(60)])))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "one"), (k + 4, "ONE"), (k + 5, "a b c d"), (k + 6, "a b c d")]
    rows += [(k + 7, " ".join(f"long{n}" for n in range(30_000))), (None, "one"), (None, None), rows[0]]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(make_docs, rng):
    rows = corpus(rng)
    docs = make_docs(rows)
    for similarity in (85, 80):
        found = minhash.near_duplicates(docs, similarity).collect()
        wanted = brute(rows, similarity)
        assert len(found) == len(rows)
        assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == wanted
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
        assert sorted(r.n_shingles for r in found) == sorted(len(shingles(t)) for _, t in rows)


def test_one_of_each_group(make_docs, rng):
    rows = corpus(rng)
    docs = make_docs(rows)
    left = minhash.keep_one(docs)
    assert left.dtypes == docs.dtypes
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(brute(rows, 85).values()))
    assert ids.count(None) == 2


def test_rows_of_one_id(make_docs):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "A B C D E F")]
    assert {r.component_id for r in minhash.near_duplicates(make_docs(rows)).collect()} == {1}


def test_empty(make_docs):
    assert minhash.near_duplicates(make_docs([])).collect() == []
    assert minhash.keep_one(make_docs([])).collect() == []


def test_components(spark, rng):
    pairs = [(k, k + 1) for k in range(100, 400)] + [(7, k) for k in range(1000, 1200)] + [(5, 5), (3, 2), (2, 3)]
    pairs += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    links = spark.createDataFrame(pairs, "a long, b long")
    alone = {5} | {a for a, b in pairs if a == b}
    wanted = union(pairs, {x for p in pairs for x in p})
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in components(links).collect()} == {k: v for k, v in wanted.items() if k in linked}
    assert alone - linked


def test_template_crowd(make_docs, rng):
    """Texts with one template are no links, but some pairs of them differ in little else."""
    words = [f"t{n}" for n in range(94)]
    rows, pairs = [], []
    for k in range(20_000):
        rows.append((k, " ".join([*words, *(f"o{k}x{n}" for n in range(10))])))
    for n in range(100):
        text = rows[n * 150][1].split()
        rows.append((20_000 + n, " ".join([*text[:-2], f"p{n}", f"q{n}"])))
        pairs.append((n * 150, 20_000 + n))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert found == union(pairs, {i for i, _ in rows})


@pytest.mark.parametrize("n", [5, 50])
def test_more_tasks_than_rows(spark, make_docs, n):
    """Neighbours that the deal by range has put into different tasks."""
    rows = []
    for k in range(n):
        words = [f"d{k}w{i}" for i in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        found = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {i: i - i % 2 for i, _ in rows}


def test_dense_groups(make_docs, rng):
    """Groups in which many pairs are links and many are just none: components as by brute force."""
    rows = []
    for share in (0.008, 0.012, 0.016, 0.03):
        base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(120):
            rows.append((len(rows), " ".join(f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in base)))
    found = {i: frozenset(minhash.shingles(t.encode()).tolist()) for i, t in rows}
    parent = {i: i for i in found}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in found:
        for j in range(i):
            if 100 * len(found[i] & found[j]) >= 85 * len(found[i] | found[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make_docs(rows)).collect()}
    assert got == {i: top(i) for i in found}
