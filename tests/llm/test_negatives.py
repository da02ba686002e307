import numpy as np
import pytest
from pyspark.sql import types as T

from opsmill.llm import negatives

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("x", T.StringType()),
        T.StructField("part", T.StringType()),
    ]
)


def brute(rows):
    """The contract, pair by pair."""
    whole = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(c is None or not np.isfinite(c) for c in vector):
            continue
        x = [int(np.floor(256 * float(np.float32(c)))) for c in vector]
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, x)
        whole[vec_id] = min(row, whole.get(vec_id, row))
    score = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = set()
    for a, (label, x) in whole.items():
        if a % 100:
            continue
        others = sorted((-score(x, y), v, kind) for v, (kind, y) in whole.items() if v != a)
        for p, positive, _ in [o for o in others if o[2] == label][:5]:
            fit = [(n, v) for n, v, kind in others if kind != label and -80 * p <= -100 * n <= -100 * p]
            out |= {(a, positive, k, v, -p, -n) for k, (n, v) in enumerate(fit[:5], 1)}
    return out


def found(spark, rows):
    df = spark.createDataFrame([(v, e, k, "x", "p") for v, e, k in rows], SCHEMA).repartition(3)
    got = negatives.hard_negatives(negatives.prepared(df)).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert len(got) == len(set(got))
    return {tuple(r[n] for n in names) for r in got}


def test_against_brute_force(spark):
    random = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        vector = (random.normal(size=6) * random.lognormal(sigma=0.7)).astype("f4").tolist()
        rows.append((i, vector, int(random.integers(0, 12))))
    # Ties, hot copies, gaps, short and empty vectors, zeros, repeated and contradicting rows.
    rows += [(2000 + i, rows[100][1], i % 3) for i in range(600)]
    rows += [(3000, None, 1), (3100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3200, [float("nan")] * 6, 1)]
    rows += [(3300, [float("inf")] + [0.0] * 5, 1), (3400, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(3500, [1.0, 2.0], 3), (3600, [], 3), (3700, [0.0] * 6, 3), (-100, rows[3][1], -4)]
    rows += [rows[0], rows[0], (200, rows[5][1], rows[200][2])]
    want = brute(rows)
    assert len(want) > 200
    assert found(spark, rows) == want


def test_no_rows_and_no_anchors(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, [1.0, 1.0], 1), (2, [1.0, 1.0], 2)]) == set()
    assert found(spark, [(100, [1.0], 1), (2, [1.0], 2)]) == set()


@pytest.mark.parametrize("largest", [400, 2**29])
@pytest.mark.parametrize("same", [True, False])
def test_pruning_loses_nothing(largest, same):
    """Buckets of like length and coordinate ranges against all products; most of the table is not verified."""
    random = np.random.default_rng(5)
    centres = random.normal(size=(40, 16)) * 4
    vectors = (centres[random.integers(0, 40, 4000)] + random.normal(size=(4000, 16)) * 0.3) * random.lognormal(
        sigma=0.8, size=(4000, 1)
    )
    x = np.floor(vectors * largest / np.abs(vectors).max()).astype(np.int64)
    lengths, _ = negatives._units(x)
    x = x[np.argsort(-lengths)]
    ids, labels = np.arange(4000) * 3, random.integers(0, 4, 4000)
    own = np.arange(0, 4000, 40)
    scores = x[own] @ x.T
    if same:
        low, high = np.full((100, 1), -np.inf), np.full((100, 1), np.inf)
    else:
        high = np.sort(scores, axis=1)[:, [-10, -20, -40]]
        low = high - high // 5
    search = negatives._Search(ids[own], labels[own], x[own], low, high, same, 5)
    for k in range(0, 4000, 200):
        part = slice(k, k + 200)
        lengths, units = negatives._units(x[part])
        lists = np.argsort(units, axis=0, kind="stable").T.astype("<u2")
        search.look(float(lengths.max()), ids[part], labels[part], x[part], lists)
    want = []
    for i, a in enumerate(own):
        kinds = (labels == labels[a]) == same
        for j in range(low.shape[1]):
            fit = np.flatnonzero(kinds & (scores[i] >= low[i, j]) & (scores[i] <= high[i, j]) & (ids != ids[a]))
            best = sorted(((-int(scores[i, r]), int(ids[r])) for r in fit))[:5]
            want += [(i * low.shape[1] + j, -s, v) for s, v in best]
    assert sorted(want) == sorted(zip(*(c.tolist() for c in search.best)))
    assert search.verified < 0.5 * len(own) * 4000
