"""Loading a folder of CSV files again and again, each file once.

A stage table keeps its rows and a ledger of the files they came from; one version
holds both, so that a load is in with its ledger or not at all, and a load that fails
leaves nothing. A file is known by path, size and time; if one of these differs, its lines decide:
the fingerprint is a sum over the hashes of its lines, taken by Spark, so that a file that
was only touched or copied over itself is not loaded again.

A file whose lines have changed is loaded anew: ``changed="replace"`` makes its new rows stand for its
older ones, ``"add"`` keeps both. Rows that do not fit follow ``on_error``: ``"continue"``
leaves them out, ``"skip_file"`` leaves out their files, ``"abort"`` ends the load.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill import places
from opsmill.sources.files import plain_path, read_stage_csv_with_rejects
from opsmill.streaming.runs import RunTable

LISTED = "path string, size bigint, modified bigint"


class LoadError(ValueError):
    """A load that was ended by rows that do not fit."""


@dataclass
class StageTable:
    spark: SparkSession
    folder: str
    schema: str
    header: bool = True
    on_error: str = "continue"
    changed: str = "replace"

    def __post_init__(self) -> None:
        if self.on_error not in ("continue", "skip_file", "abort") or self.changed not in ("replace", "add"):
            raise ValueError(f"{self.on_error}, {self.changed}")
        self._table = RunTable(self.spark, self.folder, merge_below=1 << 30)

    def ledger(self) -> DataFrame | None:
        """One row per file and load: path, size, modified, fingerprint, load, rows, rejected, status."""
        return self._table.read_beside()

    def _fingerprints(self, paths: list[str]) -> DataFrame:
        """Sum of the hashes of the lines of every file, in any order."""
        lines = self.spark.read.text(paths).select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")
        total = F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string")
        return lines.groupBy("path").agg(F.concat_ws(":", F.count("*"), total).alias("fingerprint"))

    def _new_files(self, listed: DataFrame, ledger: DataFrame | None) -> DataFrame:
        """The listed files that the ledger does not know, with their fingerprints; ``touched`` have known lines."""
        keys = ["path", "size", "modified"]
        fresh = listed if ledger is None else listed.join(ledger.select(*keys).distinct(), keys, "left_anti")
        # One short row per new file; the driver has listed them before.
        fresh = self.spark.createDataFrame(fresh.collect(), LISTED)
        paths = [r["path"] for r in fresh.collect()]
        if not paths:
            return fresh.withColumns({"fingerprint": F.lit(""), "touched": F.lit(False)})
        marked = fresh.join(self._fingerprints(paths), "path", "left").withColumn(
            "fingerprint", F.coalesce("fingerprint", F.lit("0:"))
        )
        if ledger is None:
            return marked.withColumn("touched", F.lit(False))
        last = ledger.groupBy("path").agg(F.max_by("fingerprint", "load").alias("known"))
        known = F.coalesce(F.col("known") == F.col("fingerprint"), F.lit(False))
        return marked.join(last, "path", "left").withColumn("touched", known).drop("known")

    def load(self, stage: str) -> dict[str, int]:
        """Load the files of a folder that are new or have changed; how many files and rows that were."""
        version = self._table.version()
        number, ledger = version.batch + 1, self.ledger()
        found = [(e.path, e.size, e.modified) for e in places.files_below(self.spark, stage)]
        listed = self.spark.createDataFrame(found, LISTED)
        new = self.spark.createDataFrame(self._new_files(listed, ledger).collect(), f"{LISTED}, fingerprint string, touched boolean")
        paths = [r["path"] for r in new.where("NOT touched").select("path").collect()]
        if new.isEmpty():
            return {"load": version.batch, "files": 0, "rows": 0, "rejected": 0}
        if paths:
            rows = read_stage_csv_with_rejects(self.spark, paths, self.schema, self.header, source="_file")
        else:
            rows = read_stage_csv_with_rejects(self.spark, stage, self.schema, self.header, source="_file").limit(0)
        rows = rows.withColumn("_load", F.lit(number))
        counted = rows.groupBy(F.col("_file").alias("path")).agg(
            F.count_if(F.col("_rejected").isNull()).alias("rows"), F.count("_rejected").alias("rejected")
        )
        none = F.lit(0).cast("bigint")
        entry = (
            new.join(counted, "path", "left")
            .withColumns({"rows": F.coalesce("rows", none), "rejected": F.coalesce("rejected", none), "load": F.lit(number)})
            .withColumn(
                "status",
                F.when(F.col("touched"), "known")
                .when((F.lit(self.on_error) == "skip_file") & (F.col("rejected") > 0), "skipped")
                .otherwise("loaded"),
            )
        )
        # One short row per new file.
        entries = entry.select("path", "size", "modified", "fingerprint", "load", "rows", "rejected", "status").collect()
        held = self.spark.createDataFrame(entries, f"{LISTED}, fingerprint string, load int, rows bigint, rejected bigint, status string")
        if self.on_error == "abort" and any(e["rejected"] for e in entries):
            raise LoadError(f"rows that do not fit in {min(e['path'] for e in entries if e['rejected'])}")
        if self.on_error == "skip_file":
            rows = rows.join(held.where("status = 'skipped'").select(F.col("path").alias("_file")), "_file", "left_anti")
        kept = rows.where("_rejected IS NULL").drop("_rejected")
        self._table.commit(kept, number, time.time(), beside=held)
        loaded = [e for e in entries if e["status"] == "loaded"]
        return {
            "load": number, "files": len(loaded), "rows": sum(e["rows"] for e in loaded),
            "rejected": sum(e["rejected"] for e in entries),
        }

    def read(self) -> DataFrame:
        """The loaded rows."""
        rows = self._table.read()
        if self.changed == "replace":
            loads = self.ledger().where("status = 'loaded'").select("path", "load")
            last = loads.groupBy("path").agg(F.max("load").alias("last"))
            # Only files that were loaded more than once have older rows.
            older = loads.join(last, "path").where("load < last").select(F.col("path").alias("_file"), F.col("load").alias("_load"))
            rows = rows.join(older, ["_file", "_load"], "left_anti")
        return rows.drop("_file", "_load")
