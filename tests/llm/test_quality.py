import numpy as np
import pytest
from pyspark.sql import functions as F

from opsmill.llm import quality
from opsmill.llm.common import as_bytes, table


@pytest.fixture
def labelled(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, text string")

    return make


def texts(sentence):
    good = [sentence(60) for _ in range(60)]
    bad = [" ".join([f"W{i}!!"] * 50) if i % 2 else sentence(50).upper() + " ###" for i in range(40)]
    return good, bad


def test_against_votes_one_by_one(spark, make_docs, labelled, sentence):
    good, bad = texts(sentence)
    rows = list(enumerate(good + bad + [None, "", " \n ", "ß", "a" * 200_000, good[0]]))
    docs = make_docs(rows)
    labels = labelled([(i, int(i < 60), "t") for i in range(0, 100, 2)] + [(1, None, "t"), (3, 0, "t"), (3, 1, "t"), (999, 1, "t")])
    model = quality.fit(docs, labels)
    assert len(model.labels) == 50 and model.prior == 30 / 50
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    data = [(t or "").encode() for _, t in rows]
    # Frequencies over all documents.
    having = sum(np.bincount(quality.terms(t)[0], minlength=quality.TERMS) for t in data)
    want = np.where(having > 0, np.log((1 + len(data)) / (1 + having)) + 0.1, 0)
    np.testing.assert_allclose(model.rarity, want)
    for (doc_id, _), text in zip(rows, data):
        places, weights = quality.weighed(text, model.rarity)
        vector = weights @ model.projection[places]
        length = np.linalg.norm(vector)
        if length < 1e-9:
            assert got[doc_id] == model.prior
            continue
        near = [round(float(vector / length @ v), 5) for v in model.vectors]
        votes = sorted(range(50), key=lambda k: (-near[k], k))[: quality.NEIGHBOURS]
        total = sum(max(near[k], 0) for k in votes)
        score = sum(max(near[k], 0) * model.labels[k] for k in votes) / total if total else model.prior
        assert got[doc_id] == pytest.approx(score, abs=2e-3)
    unlabelled = [i for i in range(100) if i % 2]
    assert all((got[i] >= 0.5) == (i < 60) for i in unlabelled)


def test_the_space_is_that_of_the_leading_singular_vectors():
    random = np.random.default_rng(1)
    matrix = random.normal(size=(30, 5)) @ random.normal(size=(5, 200)) + random.normal(size=(30, 200)) * 0.01
    rows = [(np.arange(200), row) for row in matrix]
    own = quality._projection(rows, 5)[:200]
    right = np.linalg.svd(matrix)[2][:5].T
    np.testing.assert_allclose(np.linalg.svd(own.T @ right)[1], 1, atol=1e-6)


def test_without_labels_and_without_documents(spark, make_docs, labelled, sentence):
    docs = make_docs([(1, "one"), (2, None), (2, "two"), (None, "none")])
    none = quality.scored(docs, quality.fit(docs, labelled([]))).collect()
    assert sorted(r["score"] for r in none) == [0.5] * 4
    empty = make_docs([])
    assert quality.scored(empty, quality.fit(empty, labelled([(1, 1, "t")]))).collect() == []
    one_kind = quality.scored(docs, quality.fit(docs, labelled([(1, 1, "t"), (2, 1, "t")]))).collect()
    assert {r["score"] for r in one_kind} == {1.0}


def test_sample_has_a_bound(spark, make_docs, labelled):
    docs = make_docs([(i % 50, f"text {i}") for i in range(200)])
    rows = quality.sample(docs, labelled([(i, i % 2, "t") for i in range(50)]), "quality", 10).collect()
    assert sorted(r["label"] for r in rows) == [0] * 10 + [1] * 10
    assert len({r["labelled_id"] for r in rows}) == 20


def test_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    rows = quality.op13(spark, sf_dir).filter("held_out").collect()
    for kind in (0, 1):
        own = [r["predicted"] for r in rows if labels.get(r["doc_id"]) == kind]
        assert np.mean(np.array(own) == kind) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert not spark.range(1).filter(quality.held_out(F.lit(None).cast("long"))).collect()


def test_nulls_are_empty():
    import pyarrow as pa

    assert as_bytes(pa.array([None, "a"])) == [b"", b"a"]
