import zlib

from pyspark.sql import functions as F

from opsmill.llm import toxicity
from opsmill.llm.common import table


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    # About 300 toxic texts to learn from; with 1,400 (five times the table) it finds 99 of 100.
    folder = "/root/testdata/sf0.1"
    rows = toxicity.op4(spark, folder)
    truth = table(spark, folder, "labels").select("doc_id", "toxic")
    found = rows.filter("held_out").join(truth, "doc_id").groupBy("toxic", "predicted").count().collect()
    table_ = {(r.toxic, r.predicted): r["count"] for r in found}
    right = table_.get((1, 1), 0)
    assert right >= 0.83 * (right + table_.get((1, 0), 0))
    assert table_.get((0, 1), 0) <= 0.01 * table_[0, 0]


def test_scores(spark, make_docs, sentence):
    rows = [(k, f"{sentence(40)} {'Horrible villain!' if k % 4 == 0 else 'good'} {sentence(40)}") for k in range(200)]
    odd = [(900, None), (901, ""), (902, "!!"), (903, "villain " * 30_000), (None, "horrible villain"), (904, "y" * 300_000)]
    docs = make_docs([*rows, *odd, rows[0]])
    labels = labelled(spark, [(k, int(k % 4 == 0)) for k, _ in rows] + [(0, 1), (None, 1), (5000, 1), (8, None), (12, 0), (12, 1)])
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + len(odd) + 1 and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    left = toxicity.reject_toxic(docs, model)
    assert left.dtypes == docs.dtypes
    ids = {r.doc_id for r in left.collect()}
    assert {900, 901, 902, 1, 2, 3} <= ids and not ids & {0, 4, 903}
    again = toxicity.fit(docs, labels)
    assert (again.codes == model.codes).all() and (again.weights == model.weights).all()


def test_sample_is_bounded(spark, make_docs):
    docs = make_docs([(k, f"text {k}") for k in range(50)])
    labels = labelled(spark, [(k, k % 2) for k in range(50)])
    assert {r.toxic: r["count"] for r in toxicity.sample(docs, labels, 5, 7).groupBy("toxic").count().collect()} == {1: 5, 0: 7}


def test_without_labels(spark, make_docs):
    docs = make_docs([(1, "a"), (2, "b")])
    model = toxicity.fit(docs, labelled(spark, []))
    assert [r.score < 0.01 for r in toxicity.scored(docs, model).collect()] == [True, True]
    assert toxicity.scored(make_docs([]), model).collect() == []


def test_held_out_rows(spark):
    ids = spark.range(50).select(F.col("id"), toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)
