"""Exact duplicates by a tree of merges of sorted digest runs, in DataFrame operations only.

Every partition of the input becomes one run: its digests, sorted, each with the
smallest (or largest) identifier and a count. In each round ``fan`` neighbouring runs
meet and are merged into one, and every merge keeps the verified best identifier.
The answer goes back down the same tree, so that no step ever sees more than ``fan``
rows of one digest of a run, however many copies a text has.

Texts are equal when they are identical after lower-casing A-Z. A digest alone never
decides: SHA-256, byte length and a second hash must all agree at every level.

Defined cases: a null text counts as empty, and empty texts equal each other. A null
identifier loses against any other. Of repeated rows (same identifier, same text) one
stays. An empty table gives an empty result. Other columns are never read, so their
names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.llm.common import lowered, only_once, table, written

#: What must agree for two texts to count as equal.
KEY = ["sha", "size", "check"]


def _digest(text: Column) -> list[Column]:
    raw = lowered(text)
    return [
        F.unhex(F.sha2(raw.cast("binary"), 256)).alias("sha"),
        F.octet_length(raw).alias("size"),
        F.xxhash64(raw).alias("check"),
    ]


def _best(keep: str, column: Column) -> Column:
    return F.max(column) if keep == "largest" else F.min(column)


def _candidate(keep: str) -> Column:
    """Identifier and row, ordered so that a null identifier is never preferred."""
    missing = F.col("doc_id").isNull()
    return F.struct(
        (~missing if keep == "largest" else missing).alias("rank"), F.col("doc_id"), F.col("row")
    )


def duplicate_groups(
    docs: DataFrame, keep: str = "smallest", fan: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), *_digest(F.col(text_col)))
        .withColumn("run", F.spark_partition_id().cast("long"))
        .withColumn("row", F.monotonically_increasing_id())
        .sortWithinPartitions(*KEY),
        "digest-rows",
    )
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = rows.groupBy("run", *KEY).agg(
        _best(keep, _candidate(keep)).alias("best"), F.count(F.lit(1)).alias("n")
    )
    levels = [written(level.sortWithinPartitions("run", *KEY), "digest-run")]
    while runs > 1:
        level = (
            levels[-1]
            .withColumn("run", F.floor(F.col("run") / fan))
            .groupBy("run", *KEY)
            .agg(_best(keep, F.col("best")).alias("best"), F.sum("n").alias("n"))
        )
        levels.append(written(level.sortWithinPartitions("run", *KEY), "digest-run"))
        runs = -(-runs // fan)
    known = levels.pop()
    while levels:
        child = levels.pop().select("run", *KEY).withColumn("parent", F.floor(F.col("run") / fan))
        above = known.withColumnRenamed("run", "parent")
        known = child.join(above, ["parent", *KEY]).drop("parent")
    return rows.join(known, ["run", *KEY]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _row_key(doc_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), sha)


def drop_duplicates(
    docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = duplicate_groups(docs, keep, id_col=id_col, text_col=text_col).filter("kept")
    keys = stay.select(_row_key(F.col("doc_id"), F.col("text_sha256")))
    sha = F.sha2(lowered(F.col(text_col)).cast("binary"), 256)
    return only_once(docs, keys, _row_key(F.col(id_col), sha))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts in ``documents`` the row with the largest doc_id stays."""
    return duplicate_groups(table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
WITH normal AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM normal
WINDOW w AS (PARTITION BY text_sha256)
"""
