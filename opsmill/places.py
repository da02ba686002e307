"""Files in the file systems Spark can reach: names, sizes, small texts, publishing.

For what the driver does with whole files (versions, ledgers, lists). Rows are read and
written by Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import SparkSession

#: Files that are moved at a time.
MOVERS = 16


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    size: int
    modified: int
    folder: bool


def _opened(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _opened(spark, path)
    return system.exists(place)


def entries(spark: SparkSession, folder: str) -> list[Entry]:
    """What is directly in a folder, by name; nothing if there is no such folder."""
    system, place = _opened(spark, folder)
    if not system.exists(place):
        return []
    found = [
        Entry(s.getPath().toString(), s.getPath().getName(), s.getLen(), s.getModificationTime(), s.isDirectory())
        for s in system.listStatus(place)
    ]
    return sorted(found, key=lambda e: e.name)


def files_below(spark: SparkSession, folder: str) -> list[Entry]:
    """All data files below a folder; names that begin with ``_`` or ``.`` are no data."""
    out, waiting = [], [folder]
    while waiting:
        for entry in entries(spark, waiting.pop()):
            if entry.name.startswith(("_", ".")):
                continue
            if entry.folder:
                waiting.append(entry.path)
            else:
                out.append(entry)
    return sorted(out, key=lambda e: e.path)


def bytes_below(spark: SparkSession, folder: str) -> int:
    system, place = _opened(spark, folder)
    return system.getContentSummary(place).getLength() if system.exists(place) else 0


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _opened(spark, path)
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text whole or not at all; a file that is there already is an error."""
    system, place = _opened(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if system.exists(place) or not system.rename(draft, place):
        system.delete(draft, False)
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    system, place = _opened(spark, path)
    system.delete(place, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in its place; an empty one if there is none, and nothing of an older one stays."""
    system, place = _opened(spark, target)
    system.delete(place, True)
    system.mkdirs(place.getParent())
    origin = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if not system.exists(origin):
        system.mkdirs(place)
    elif not system.rename(origin, place):
        raise OSError(f"{source} could not become {target}")


def move_files(spark: SparkSession, glob: str, folder: str, name: Callable[[str], str]) -> None:
    """Move the files of a pattern into one folder, each named after the folder it was in.

    All are found by one listing, and ``MOVERS`` are moved at a time, as a file system answers many at once.
    """
    system, place = _opened(spark, folder)
    path, origin = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, _opened(spark, glob)[1]
    system.mkdirs(place)

    def move(source: str) -> None:
        target = f"{folder}/{name(source.rsplit('/', 2)[1])}"
        if not system.rename(path(source), path(target)):
            raise OSError(f"{source} could not become {target}")

    found = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(system.globStatus(origin))
    sources = [p.toString() for p in found]
    if len({s.rsplit("/", 2)[1] for s in sources}) < len(sources):
        raise ValueError(f"two files of one folder match {glob}")
    with ThreadPoolExecutor(MOVERS) as movers:
        for _ in movers.map(move, sources):
            pass


def join_files(spark: SparkSession, sources: list[str], target: str) -> None:
    """Make one file of several, in their order; the sources are gone then, an older target is replaced.

    One source is renamed. More are concatenated by the file system if it can do that, else they are
    copied one after another, a buffer at a time.
    """
    jvm = spark.sparkContext._jvm
    system, place = _opened(spark, target)
    parts = [jvm.org.apache.hadoop.fs.Path(s) for s in sources]
    whole = parts[0]
    if len(parts) > 1:
        try:
            rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts) - 1)
            for k, part in enumerate(parts[1:]):
                rest[k] = part
            system.concat(parts[0], rest)
        except UnsupportedOperationException:
            whole = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
            out = system.create(whole, False)
            for part in parts:
                data = system.open(part)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 16, False)
                data.close()
            out.close()
            for part in parts:
                system.delete(part, False)
    system.mkdirs(place.getParent())
    system.delete(place, False)
    if not system.rename(whole, place):
        raise OSError(f"{target} could not be written")
