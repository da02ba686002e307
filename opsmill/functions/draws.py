"""Repeatable random draws.

Each draw is a function of (seed, column tag, row id) only, so a lost
partition is rebuilt with the same values and the result does not depend on
how the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(row_id: Column, seed: int, tag: str) -> Column:
    """A double in [0, 1) with 32 random bits."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), row_id.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_int(row_id: Column, seed: int, tag: str, low: int, high: int) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    return (F.floor(draw(row_id, seed, tag) * (high - low + 1)) + low).cast("bigint")


def uniform_real(
    row_id: Column, seed: int, tag: str, low: float, high: float, digits: int = 2
) -> Column:
    """A number from ``low`` to ``high``, rounded to ``digits``."""
    return F.round(draw(row_id, seed, tag) * (high - low) + low, digits)


def pick(row_id: Column, seed: int, tag: str, options: list[str], spare: int = 1) -> Column:
    """One of ``options``, or NULL when the draw falls on one of ``spare`` extra slots."""
    number = uniform_int(row_id, seed, tag, 0, len(options) - 1 + spare)
    return F.get(F.array(*[F.lit(o) for o in options]), number.cast("int"))


def uuid_text(row_id: Column, seed: int, tag: str) -> Column:
    """A UUID-shaped text, unique as far as the row id is."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), row_id.cast("string")))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
