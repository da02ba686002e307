"""File readers. Each one returns a DataFrame and leaves the splitting to Spark."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from opsmill.functions.xml import strip_outer_element

PLAN_SCHEMA = "status string, operations array<struct<operation:string,object_name:string>>"
LINT_SCHEMA = (
    "filepath string,"
    "violations array<struct<code:string,description:string,start_line_no:int>>"
)
REPORT_TEST = "struct<name:string,status:string,duration:bigint,message:string,suite:string>"
REPORT_SCHEMA = (
    "reportFormat string, specVersion string, results struct<"
    "tool:struct<name:string>,"
    "summary:struct<tests:bigint,passed:bigint,failed:bigint,skipped:bigint,"
    "pending:bigint,other:bigint,start:bigint,stop:bigint>,"
    f"tests:array<{REPORT_TEST}>,"
    "environment:struct<projectName:string,database:string,schema:string>>"
)
DEPENDENCY_SCHEMA = (
    "referenced_database string, referenced_schema string, referenced_object_name string,"
    "referenced_object_id bigint, referencing_database string, referencing_schema string,"
    "referencing_object_name string, referencing_object_domain string, referencing_object_id bigint"
)


def _whole_texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(path, wholetext=True)
    )


def as_messages(raw: DataFrame, strip_outer: bool = False) -> DataFrame:
    """Whole-text rows of a landing folder as ``(file_name, load_ts, raw_xml)``."""
    text = strip_outer_element(F.col("value")) if strip_outer else F.col("value")
    return raw.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.current_timestamp().alias("load_ts"),
        text.alias("raw_xml"),
    )


def read_messages(spark: SparkSession, path: str, strip_outer: bool = False) -> DataFrame:
    """XML messages of a landing folder, one file per row."""
    return as_messages(_whole_texts(spark, path, "*.xml"), strip_outer)


def plain_path(path: Column) -> Column:
    """A path as file systems write it, of one that is encoded as in a URL."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def read_stage_csv_with_rejects(
    spark: SparkSession, path: str | list[str], schema: str, header: bool = True, source: str | None = None
) -> DataFrame:
    """Comma-separated landing files; ``_rejected`` holds the text of rows that do not fit.

    ``source`` names a column for the file that a row is from. Fields are read as text and cast here, so whether a row fits depends on all
    its fields and never on the columns a query happens to read.
    """
    fields = DataType.fromDDL(schema).fields
    as_text = ", ".join(f"`{f.name}` string" for f in fields)
    raw = (
        spark.read.schema(f"{as_text}, _line string")
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line")
        .csv(path)
    )
    typed = [F.col(f.name).try_cast(f.dataType) for f in fields]
    misfits = [F.col(f.name).isNotNull() & value.isNull() for f, value in zip(fields, typed)]
    misfit = reduce(or_, misfits, F.col("_line").isNotNull())
    text = F.coalesce("_line", F.concat_ws(",", *[f.name for f in fields]))
    return raw.select(
        *[value.alias(f.name) for f, value in zip(fields, typed)],
        F.when(misfit, text).alias("_rejected"),
        *([] if source is None else [plain_path(F.col("_metadata.file_path")).alias(source)]),
    )


def read_stage_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Comma-separated landing files; loading goes on past rows that do not fit."""
    rows = read_stage_csv_with_rejects(spark, path, schema, header)
    return rows.where(F.col("_rejected").isNull()).drop("_rejected")


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """``*.sql`` files (or one file) as ``(file, text)``; bad UTF-8 is replaced."""
    return _whole_texts(spark, path, "*.sql").select(
        F.col("_metadata.file_path").alias("file"),
        F.make_valid_utf8(F.col("value")).alias("text"),
    )


def read_script_lines(spark: SparkSession, path: str) -> DataFrame:
    """``*.sql`` files split within the file, as ``(file, block, value)``.

    For dumps too large for one row per file. Blocks are the byte ranges
    Spark reads; within one, rows keep the file's order.
    """
    return (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.sql")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.make_valid_utf8(F.col("value")).alias("value"),
        )
    )


def split_assertions(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``(name, query, expected)`` from lines ``name | query | expected``.

    With ``strict`` the third field takes everything after the second bar. By
    default the query reaches to the last bar, so that it may hold ``||``.
    """
    value = F.col("value")
    if strict:
        parts = F.split(value, r"\|", 3)
        name, query, expected = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    else:
        three = value.rlike(r"^[^|]*\|.*\|")
        name = F.regexp_extract(value, r"^([^|]*)", 1)
        query = F.when(three, F.regexp_extract(value, r"^[^|]*\|(.*)\|[^|]*$", 1)).otherwise(
            F.regexp_extract(value, r"^[^|]*\|(.*)$", 1)
        )
        expected = F.when(three, F.regexp_extract(value, r"\|([^|]*)$", 1)).otherwise("")
    others = [F.col(c) for c in lines.columns if c != "value"]
    return lines.select(
        *others,
        name.alias("name"),
        F.coalesce(query, F.lit("")).alias("query"),
        F.coalesce(expected, F.lit("")).alias("expected"),
    )


def read_assertions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """An assertion file with its line numbers, as ``(seq, name, query, expected)``.

    The empty piece after the last line end is not a line. With ``strict`` a
    last line without a line end is left out, too.
    """
    pieces = F.split(F.regexp_replace("value", "\n$", ""), "\n")
    if strict:
        every = F.split("value", "\n")
        pieces = F.slice(every, 1, F.size(every) - 1)
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(pieces).alias("pos", "value")
    )
    return split_assertions(lines.select((F.col("pos") + 1).alias("seq"), "value"), strict)


def read_lint_json(spark: SparkSession, path: str) -> DataFrame:
    """External linter output: one row per file with its violations."""
    return spark.read.schema(LINT_SCHEMA).option("multiLine", True).json(path)


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """``TEST_*.xml`` files below ``path`` as ``(path, xml)``."""
    return _whole_texts(spark, path, "TEST_*.xml").select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml")
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Past test reports ``TEST_*.json`` below ``path``, with their path."""
    return (
        spark.read.schema(REPORT_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "TEST_*.json")
        .json(path)
        .select(F.col("_metadata.file_path").alias("path"), "reportFormat", "specVersion", "results")
    )


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """Deployment plan documents, one per file."""
    return (
        spark.read.schema(PLAN_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .json(path)
        .select(F.col("_metadata.file_path").alias("path"), "status", "operations")
    )


def read_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """Object dependency edges from CSV files with a header."""
    return spark.read.schema(DEPENDENCY_SCHEMA).option("header", True).csv(path)


def is_sql_path(path: Column) -> Column:
    """Whether a path names a ``.sql`` file."""
    return path.rlike(r"\.sql$")

