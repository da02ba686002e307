"""Tables made of runs.

A batch adds a run (a folder of Parquet files); a version names the runs that make up the
table. Versions are small files that appear whole, one after another, so that a reader
sees all of a batch or nothing, and a replayed batch is known by its number.

Runs are merged as they come: a new run takes in the runs before it that are smaller than
twice its size. So sizes fall at least by half from run to run, there are as many runs as
the logarithm of the table's size, and all of them together are at most twice the largest.
How many batches there have been does not count. A table that only grows need not merge
runs beyond ``merge_below`` bytes.

A table has one writer. Runs of the last two versions stay for readers; what no version
names (of a writer that stopped half way, too) is deleted by the next commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from opsmill import places

#: Versions whose runs stay.
KEPT = 2
ORDER = "_run_order"


@dataclass(frozen=True)
class Run:
    path: str
    size: int


@dataclass(frozen=True)
class Version:
    number: int = -1
    batch: int = -1
    #: When the batch began (seconds since 1970): what had landed by then is in this version.
    began: float = 0.0
    runs: list[Run] = field(default_factory=list)
    #: What the last batch added, by itself.
    increment: Run | None = None
    #: The table's columns, as JSON.
    schema: str = ""
    #: Runs and columns of a smaller table that goes with this one, such as what has been loaded.
    beside: list[Run] = field(default_factory=list)
    beside_schema: str = ""


def appended(rows: DataFrame) -> DataFrame:
    """Runs of a table that only grows."""
    return rows.drop(ORDER)


@dataclass
class RunTable:
    spark: SparkSession
    folder: str
    #: Makes one run of several; column ``_run_order`` tells older rows from newer ones.
    merged: Callable[[DataFrame], DataFrame] = appended
    #: Size from which a run is left alone; None merges runs of any size, 0 none.
    merge_below: int | None = None
    partition_by: tuple[str, ...] = ()

    def versions(self) -> list[str]:
        found = places.entries(self.spark, f"{self.folder}/_versions")
        return [e.path for e in found if e.name.endswith(".json") and not e.name.startswith(".")]

    def version(self, back: int = 0) -> Version:
        """The latest version, or one ``back`` before it; an empty one if there is none."""
        paths = self.versions()
        if len(paths) <= back:
            return Version()
        raw = json.loads(places.read_text(self.spark, paths[-1 - back]))
        runs, beside = ([Run(**r) for r in raw.pop(name)] for name in ("runs", "beside"))
        increment = raw.pop("increment")
        return Version(**raw, runs=runs, beside=beside, increment=Run(**increment) if increment else None)

    def rows(self, runs: list[Run], schema: StructType) -> DataFrame:
        """The rows of some runs, with their order."""
        parts = [self.spark.read.schema(schema).parquet(r.path).withColumn(ORDER, F.lit(i)) for i, r in enumerate(runs)]
        if parts:
            return reduce(DataFrame.unionByName, parts)
        # Known to be empty when it is planned, so that joins with it are left out.
        columns = [F.lit(None).cast(c.dataType).alias(c.name) for c in schema.fields]
        return self.spark.range(1).limit(0).select(*columns, F.lit(0).alias(ORDER))

    def read(self) -> DataFrame:
        """The table as its latest version has it."""
        now = self.version()
        if not now.runs:
            raise FileNotFoundError(f"{self.folder} has no version yet")
        rows = self.rows(now.runs, StructType.fromJson(json.loads(now.schema)))
        return self.merged(rows) if len(now.runs) > 1 else rows.drop(ORDER)

    def read_beside(self) -> DataFrame | None:
        """The table that goes with this one, as the same version has it; None if there is no version."""
        now = self.version()
        if not now.beside:
            return None
        return self.rows(now.beside, StructType.fromJson(json.loads(now.beside_schema))).drop(ORDER)

    def _write(self, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> Run:
        path = f"{self.folder}/run={uuid.uuid4().hex}"
        # Small parts are put together, large ones split, by their measured size.
        writer = rows.hint("rebalance", *partition_by).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return Run(path, places.bytes_below(self.spark, path))

    def _taken_in(self, runs: list[Run], added: Run, schema: StructType, merged: Callable, partition_by: tuple = ()) -> list[Run]:
        """The runs with a new one, which takes in those before it that are not much larger."""
        runs, taken, size = list(runs), [added], added.size
        while runs and runs[-1].size < 2 * size and (self.merge_below is None or runs[-1].size < self.merge_below):
            taken.insert(0, runs.pop())
            size += taken[0].size
        return [*runs, self._write(merged(self.rows(taken, schema)), partition_by) if len(taken) > 1 else added]

    def commit(self, rows: DataFrame, batch: int, began: float = 0.0, beside: DataFrame | None = None) -> Version:
        """Add the rows of a batch and make them visible; a batch that is in already changes nothing."""
        now = self.version()
        if now.batch >= batch:
            return now
        added = self._write(rows, self.partition_by)
        runs = self._taken_in(now.runs, added, rows.schema, self.merged, self.partition_by)
        others, columns = now.beside, now.beside_schema
        if beside is not None:
            others = self._taken_in(others, self._write(beside), beside.schema, appended)
            columns = beside.schema.json()
        new = Version(now.number + 1, batch, began, runs, added, rows.schema.json(), others, columns)
        places.publish(self.spark, f"{self.folder}/_versions/{new.number:012d}.json", json.dumps(asdict(new)))
        self._sweep()
        return new

    def _sweep(self) -> None:
        paths = self.versions()
        named = set()
        for back in range(min(KEPT, len(paths))):
            version = self.version(back)
            held = [*version.runs, *version.beside, *filter(None, [version.increment])]
            named |= {r.path.rsplit("/", 1)[-1] for r in held}
        for path in paths[:-KEPT]:
            places.delete(self.spark, path)
        for entry in places.entries(self.spark, self.folder):
            if entry.name.startswith("run=") and entry.name not in named:
                places.delete(self.spark, entry.path)
