"""Writing tables, files and schema snapshots."""

from __future__ import annotations

import json
import re
import uuid
from hashlib import sha256
from urllib.parse import unquote

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from opsmill import places

#: Parts into which the rows of a folder can be dealt while it is copied.
SPREAD = 1024


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` by name, cast; columns ``df`` lacks are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in DataType.fromDDL(schema).fields
        ]
    )


def replace_table(df: DataFrame, table: str, schema: str, layout: str = "parquet") -> None:
    """Create or replace ``table`` with declared types."""
    conform(df, schema).write.format(layout).mode("overwrite").saveAsTable(table)


def insert_into(df: DataFrame, table: str, columns: list[str] | None = None) -> None:
    """Append rows; ``columns`` names the targets of ``df``'s columns, the others get NULL.

    Without ``columns``, all columns are taken by position.
    """
    target = df.sparkSession.table(table).schema
    names = columns or target.names
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns for {len(names)} targets")
    given = dict(zip(names, df.columns))
    df.select(
        *[
            (F.col(given[f.name]) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    ).write.insertInto(table)


def replace_view(df: DataFrame, view: str, columns: list[str] | None = None) -> None:
    """Create or replace a view, with its own column names if given."""
    (df.toDF(*columns) if columns else df).createOrReplaceTempView(view)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header."""
    df.write.option("header", True).mode("overwrite").csv(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """``(path, document)`` rows as JSON lines; the source path stays a column, not a file."""
    documents.write.mode("overwrite").json(path)


def snapshot_name(schema: str, release: str | None) -> str:
    """Name of a schema's snapshot for a release; the schema itself for none or ``0``."""
    return schema if not release or release == "0" else f"{schema}_{release}"


def _details(spark: SparkSession, name: str) -> dict[str, str]:
    """What the catalogue says about a table or view (Provider, Comment, View Text ...)."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    names = [r["col_name"] for r in rows]
    start = names.index("# Detailed Table Information") if "# Detailed Table Information" in names else 0
    return {r["col_name"]: r["data_type"] for r in rows[start + 1 :]}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _create_views(spark: SparkSession, schema: str, target: str, views: dict[str, dict[str, str]]) -> None:
    """Views against the snapshot; one that needs another waits for it."""
    own = re.compile(rf"(?<![\w`.])(?:`{re.escape(schema)}`|{re.escape(schema)})(?=\s*\.)", re.I)
    current = spark.catalog.currentDatabase()
    waiting = dict(views)
    try:
        spark.catalog.setCurrentDatabase(target)
        while waiting:
            failed: dict[str, PySparkException] = {}
            for name, details in waiting.items():
                comment = f" COMMENT {_quoted(details['Comment'])}" if details.get("Comment") else ""
                text = own.sub(f"`{target}`", details["View Text"])
                try:
                    spark.sql(f"CREATE VIEW `{target}`.`{name}`{comment} AS {text}")
                except PySparkException as error:
                    failed[name] = error
            if len(failed) == len(waiting):
                raise next(iter(failed.values()))
            waiting = {name: waiting[name] for name in failed}
    finally:
        spark.catalog.setCurrentDatabase(current)


def _leaves(spark: SparkSession, place: str, layout: str, schema: StructType, depth: int) -> dict[str, str]:
    """The folders of a table that hold files, from below its place, each with the name of its copy.

    The name is a digest of the table's layout and of the names, sizes and times of the folder's files.
    """
    files: dict[str, list] = {}
    for entry in places.files_below(spark, place):
        parts = entry.path.rsplit("/", depth + 1)[1:-1]
        files.setdefault("/".join(parts), []).append((entry.name, entry.size, entry.modified))
    shape = [layout, schema.json()]
    return {leaf: sha256(json.dumps([shape, sorted(f)]).encode()).hexdigest()[:32] for leaf, f in files.items()}


def _copy_leaves(
    spark: SparkSession, source: str, place: str, layout: str, copies: str, leaves: dict[str, str], parts: list[str]
) -> None:
    """Copy the folders of a table that have no copy yet, in one job."""
    new = {leaf: name for leaf, name in leaves.items() if not places.exists(spark, f"{copies}/{name}/_SUCCESS")}
    if not new:
        return
    if not parts:
        # Spark's own mark tells a whole copy from one that stopped.
        (name,) = new.values()
        spark.table(source).write.format(layout).mode("overwrite").save(f"{copies}/{name}")
        return
    draft = f"{copies}/_draft-{uuid.uuid4().hex}"
    path = F.split(F.col("_metadata.file_path"), "/")
    leaf = F.array_join(F.slice(path, -1 - len(parts), len(parts)), "/")
    # An inline table, whose size Spark knows: the rows need no shuffle and sort to find their folder.
    known = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in new.items() for x in pair])).alias("_leaf", "_copy"))
    rows = spark.table(source)
    if len(new) < len(leaves) and layout in ("parquet", "orc"):
        # Only the folders that have changed are read. Other formats may have options of their table.
        reader = spark.read.format(layout).schema(rows.schema).option("basePath", place)
        rows = reader.load([f"{place}/{leaf}" for leaf in sorted(new)])
    # Paths in the metadata are encoded as in a URL.
    kept = rows.withColumn("_leaf", F.url_decode(F.replace(leaf, F.lit("+"), F.lit("%2B"))))
    changed = kept.join(known, "_leaf").drop("_leaf", *parts)
    # What a task sorts by folder is bounded, also if all rows are of one folder.
    plain = [name for name, kind in changed.dtypes if name != "_copy" and not re.search("map<|variant|interval", kind)]
    spread = F.pmod(F.xxhash64(*plain), F.lit(SPREAD)) if plain else F.lit(0)
    dealt = changed.withColumn("_spread", spread).hint("rebalance", "_copy", "_spread").drop("_spread")
    dealt.write.format(layout).partitionBy("_copy").save(draft)
    for name in new.values():
        # A folder whose files hold no rows has no part in the draft.
        places.move_folder(spark, f"{draft}/_copy={name}", f"{copies}/{name}")
        places.publish(spark, f"{copies}/{name}/_SUCCESS", "")
    places.delete(spark, draft)


def _partition_clause(leaf: str, copy: str) -> str:
    pairs = [piece.split("=", 1) for piece in leaf.split("/")]
    values = ["NULL" if v == "__HIVE_DEFAULT_PARTITION__" else _quoted(unquote(v)) for _, v in pairs]
    return f"PARTITION ({', '.join(f'`{unquote(n)}` = {v}' for (n, _), v in zip(pairs, values))}) LOCATION '{copy}'"


def snapshot_schema(
    spark: SparkSession, schema: str, release: str, location: str | None = None
) -> str:
    """Keep the tables and views of ``schema`` as a release snapshot, replacing an older one.

    All snapshots of a schema below one ``location`` (the warehouse, if not given) share copies. What is
    copied is a folder of a table (the table, or one of its partitions); its copy is named by what
    is in it, so that a release copies only folders that have changed since any release that is
    still there, and the others are referred to. Tables keep format, partitioning and comment; views are
    created again over the copies.

    A release says first which copies it needs, which keeps them from being swept; then they
    are made, and only then is the older snapshot dropped and the new one registered, so that
    a copy that fails leaves the older one as it was. Rows are copied by Spark, one job for
    each table that has changed; the loops are over catalogue entries and folders.
    """
    target = snapshot_name(schema, release)
    if target == schema:
        raise ValueError("a snapshot needs a release other than 0")
    above = location or spark.conf.get("spark.sql.warehouse.dir")
    shared = f"{above.rstrip('/')}/{schema}.copies"
    folder = f"{shared}/releases/{uuid.uuid4().hex}"
    tables, views = {}, {}
    for table in spark.catalog.listTables(schema):
        if table.isTemporary:
            continue
        source = f"`{schema}`.`{table.name}`"
        details = _details(spark, source)
        if table.tableType == "VIEW":
            views[table.name] = details
            continue
        parts = [c.name for c in spark.catalog.listColumns(source) if c.isPartition]
        layout, fields = details.get("Provider", "parquet"), spark.table(source).schema
        leaves = _leaves(spark, details["Location"], layout, fields, len(parts))
        tables[table.name] = (fields, layout, parts, details, leaves)
    named = {name: sorted(set(leaves.values())) for name, (*_, leaves) in tables.items()}
    places.publish(spark, f"{folder}/release.json", json.dumps({"release": target, "copies": named}))
    try:
        for name, (_, layout, parts, details, leaves) in tables.items():
            _copy_leaves(
                spark, f"`{schema}`.`{name}`", details["Location"], layout, f"{shared}/tables/{name}", leaves, parts
            )
    except Exception:
        places.delete(spark, folder)
        _sweep_copies(spark, shared)
        raise
    drop_snapshot(spark, schema, release)
    spark.sql(f"CREATE DATABASE `{target}` LOCATION '{folder}'")
    for name, (fields, layout, parts, details, leaves) in tables.items():
        copy, copies = f"`{target}`.`{name}`", f"{shared}/tables/{name}"
        whole = f"{folder}/{name}" if parts or not leaves else f"{copies}/{leaves['']}"
        dealt = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else ""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {copy} ({columns}) USING {layout}{dealt} LOCATION '{whole}'")
        if parts:
            clauses = [_partition_clause(leaf, f"{copies}/{own}") for leaf, own in sorted(leaves.items())]
            for k in range(0, len(clauses), 200):
                spark.sql(f"ALTER TABLE {copy} ADD {' '.join(clauses[k : k + 200])}")
        if details.get("Comment"):
            spark.sql(f"COMMENT ON TABLE {copy} IS {_quoted(details['Comment'])}")
    _create_views(spark, schema, target, views)
    return target


def _sweep_copies(spark: SparkSession, shared: str) -> None:
    """Delete the copies that no release of a schema needs."""
    needed: set[tuple[str, str]] = set()
    for entry in places.entries(spark, f"{shared}/releases"):
        if places.exists(spark, f"{entry.path}/release.json"):
            held = json.loads(places.read_text(spark, f"{entry.path}/release.json"))["copies"]
            needed |= {(table, name) for table, names in held.items() for name in names}
    for table in places.entries(spark, f"{shared}/tables"):
        for copy in places.entries(spark, table.path):
            if (table.name, copy.name) not in needed:
                places.delete(spark, copy.path)


def drop_snapshot(spark: SparkSession, schema: str, release: str) -> None:
    """Drop a release snapshot, if there is one, with the copies that no other release needs."""
    target = snapshot_name(schema, release)
    if target == schema:
        raise ValueError("a snapshot needs a release other than 0")
    if not spark.catalog.databaseExists(target):
        return
    folder = spark.catalog.getDatabase(target).locationUri.rstrip("/")
    spark.sql(f"DROP DATABASE `{target}` CASCADE")
    if "/releases/" in folder:
        places.delete(spark, folder)
        _sweep_copies(spark, folder.rsplit("/releases/", 1)[0])


def stamped(df: DataFrame, column: str, now: Column | None = None) -> DataFrame:
    """``column`` with the load time where it is missing (a column default)."""
    now = F.current_timestamp() if now is None else now
    value = F.coalesce(F.col(column), now) if column in df.columns else now
    return df.withColumn(column, value)
