"""What several of the operators share: tables, written intermediates, batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows in one Arrow batch. Python workers hold one batch, so that its texts bound their memory.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse, which all executors share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written to the shared folder and read from there.

    Cuts the lineage: what is lost with an executor is read again, not made again.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def _packed_code() -> str:
    """The package as a zip file, for executors on which it is not installed."""
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    return str(target)


_READY: set[str] = set()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Have Spark hand texts to Python in batches of few rows, to workers that know this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.sparkContext.applicationId not in _READY:
        spark.sparkContext.addPyFile(_packed_code())
        _READY.add(spark.sparkContext.applicationId)


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def crc_text(column: Column) -> Column:
    """CRC-32 of a value written as text; a null value counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text of a batch; null becomes empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def chunks(data: list, limit: int, size=len) -> Iterator[list]:
    """Consecutive parts of a list, each of about ``limit`` bytes, or one longer item."""
    part, held = [], 0
    for item in data:
        if part and held + size(item) > limit:
            yield part
            part, held = [], 0
        part.append(item)
        held += size(item)
    if part:
        yield part


def only_once(docs: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in the one column of ``keys``, one row for each key.

    Join and window share one exchange by the key, so that texts move once.
    """
    from pyspark.sql import Window

    mark, rank = f"key_{uuid.uuid4().hex}", f"rank_{uuid.uuid4().hex}"
    names = docs.columns
    picked = docs.withColumn(mark, key).join(keys.toDF(mark), mark, "left_semi")
    order = Window.partitionBy(mark).orderBy(mark)
    return picked.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1).select(
        *[F.col(f"`{n}`") for n in names]
    )
