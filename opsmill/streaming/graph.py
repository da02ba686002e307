"""Maintained tables that are built on each other, refreshed in order from one stream.

All tables of a graph take part in one stream of the base rows, whose checkpoint is their
shared progress. A batch refreshes the tables one after another, each after those it is
built on, and each commits its part under the number of the batch. A batch that was stopped
between two tables is given again by the stream with the same rows and number: tables
that have it hand on what they added, the others go on from there. So tables that show the same
batch are of the same base rows.

Lags are passed on: a table must be as fresh as the most demanding table built on it. A
refresh begins every half of the least lag, so that no table is behind by more, as long
as a refresh takes at most the other half.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from opsmill import places
from opsmill.streaming.runs import ORDER, RunTable, Version

BASE = "base"


@dataclass(frozen=True)
class Maintained:
    """A table, the tables (or the base) it is built on, and what a batch adds to it."""

    name: str
    inputs: tuple[str, ...]
    added: Callable[["Batch"], DataFrame]
    #: Longest time the table may be behind, in seconds; None leaves it to the tables built on it.
    lag: float | None = None
    partition_by: tuple[str, ...] = ()
    #: Size in bytes up to which runs are merged.
    merge_below: int | None = 1 << 30
    #: Where the table is, if not below the graph's folder.
    folder: str | None = None


@dataclass
class Batch:
    """What a refresh sees: the base rows of the batch, and its inputs before and by it."""

    base: DataFrame
    tables: dict[str, RunTable]
    number: int

    def _of(self, name: str, back: int) -> tuple[RunTable, Version, StructType]:
        table = self.tables[name]
        return table, table.version(back), StructType.fromJson(json.loads(table.version().schema))

    def new(self, name: str) -> DataFrame:
        """The rows that this batch has added to an input."""
        table, version, schema = self._of(name, 0)
        return table.rows([version.increment], schema).drop(ORDER)

    def before(self, name: str) -> DataFrame:
        """The rows that an input had before this batch."""
        table, version, schema = self._of(name, 1)
        return table.rows(version.runs, schema).drop(ORDER)

    def folders(self, name: str) -> list[str]:
        """Values of the first partition column in what this batch has added to an input."""
        table, version, _ = self._of(name, 0)
        found = [e.name for e in places.entries(table.spark, version.increment.path) if e.folder]
        return [n.split("=", 1)[1] for n in found if "=" in n]


class RefreshGraph:
    def __init__(self, spark: SparkSession, folder: str, tables: list[Maintained]) -> None:
        self.spark, self.folder = spark, folder
        named = {t.name: t for t in tables}
        unknown = {i for t in tables for i in t.inputs} - set(named) - {BASE}
        if unknown or len(named) != len(tables) or BASE in named:
            raise ValueError(f"tables need names of their own and known inputs: {sorted(unknown)}")
        order = TopologicalSorter({t.name: [i for i in t.inputs if i != BASE] for t in tables}).static_order()
        self.order = [named[name] for name in order]
        self.tables = {
            t.name: RunTable(
                spark, t.folder or f"{folder}/{t.name}", merge_below=t.merge_below, partition_by=t.partition_by
            )
            for t in tables
        }

    def lags(self) -> dict[str, float | None]:
        """The lag each table must keep: its own, or that of a table built on it if that is less."""
        out: dict[str, float | None] = {t.name: t.lag for t in self.order}
        for table in reversed(self.order):
            for name in table.inputs:
                asked = [lag for lag in (out.get(name), out[table.name]) if lag is not None]
                if name != BASE and asked:
                    out[name] = min(asked)
        return out

    def refresh(self, base: DataFrame, number: int) -> None:
        """Bring all tables up to this batch, in order."""
        began = time.time()
        for table in self.order:
            if self.tables[table.name].version().batch < number:
                self.tables[table.name].commit(table.added(Batch(base, self.tables, number)), number, began)

    def start(self, base: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Keep all tables up to date with the stream ``base``; ``once`` takes what is there and stops."""
        writer = base.writeStream.foreachBatch(self.refresh).option("checkpointLocation", checkpoint)
        if once:
            return writer.trigger(availableNow=True).start()
        lags = [lag for lag in self.lags().values() if lag is not None]
        if not lags:
            raise ValueError("no table of the graph has a lag")
        return writer.trigger(processingTime=f"{int(min(lags) * 500)} milliseconds").start()

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def status(self, now: float | None = None) -> DataFrame:
        """One row per table: its place in the order, batch, lag, seconds behind, and whether that is in the lag."""
        now, lags, rows = time.time() if now is None else now, self.lags(), []
        for place, table in enumerate(self.order):
            version, lag = self.tables[table.name].version(), lags[table.name]
            lag = None if lag is None else float(lag)
            behind = now - version.began
            kept = version.batch >= 0 and (lag is None or behind <= lag)
            rows.append((table.name, place, version.batch, lag, behind, kept))
        schema = "name string, place int, batch long, lag double, behind double, in_lag boolean"
        return self.spark.createDataFrame(rows, schema)
