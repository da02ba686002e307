import corpus_pipeline
import pytest

import __spark_entry__ as entry
from opsmill.llm import exact_dedup, registry
from opsmill.llm.common import table


def test_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in entry.queries()) == 1 for n in names)
    assert "pipeline" in entry.queries() and set(registry.ORACLES) <= set(registry.QUERIES)


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    names = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        rows = stage(spark, docs, folder).collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == names
        left[name] = {r.doc_id: r.text for r in rows}
        assert left[name].items() <= before.items() and len(rows) == len(left[name])
    groups = {r.text_sha256 for r in exact_dedup.duplicate_groups(docs).collect()}
    assert len(groups) == docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} == set(left["decontamination"])
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(whole) == sorted(last)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_whole_result(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    source = {"op5": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    each = 4 if source == "embeddings" else 1
    assert df.count() == each * table(spark, sf_dir, source).count()


def test_near_copies_from_eighty_hundredths(spark, make_docs):
    """Of 96 shingles the copies share 96 - k: 0.83 for k = 9, 0.78 for k = 12."""
    rows = []
    for k, changed in enumerate([9, 12, 9, 9]):
        words = [f"d{k}w{n}" for n in range(100)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-changed], *(f"n{k}x{n}" for n in range(changed))]))]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, make_docs(rows), "").collect()}
    assert kept == {0, 2, 3, 4, 6}


def test_nulls_clashing_columns_and_no_rows(spark, make_docs, sentence, tmp_path):
    folder = str(tmp_path)
    text = sentence(40)
    rows = [(1, text), (2, text.upper()), (3, None), (None, sentence(30)), (None, None), (4, ""), (5, sentence(50)), (5, sentence(50))]
    labels = spark.createDataFrame([(9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("b", "some words of a benchmark"), (None, None)], "item_id string, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    for given in (rows, []):
        docs = make_docs(given)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, folder)
            assert kept.columns == docs.columns
            docs = spark.createDataFrame(kept.collect(), kept.schema)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        left = [r.doc_id for r in docs.collect()]
        assert sorted(map(str, left)) == sorted(str(r.doc_id) for r in out)
        # Of equal texts one stays (copies 1 and 2; the three empty ones); rows that share an
        # identifier count as one document for near copies.
        assert sorted(map(str, left)) == (["1", "3", "5", "None"] if given else [])
