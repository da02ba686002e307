"""Row functions that the optimizer must keep in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once per row.

    A filter on a plain computed column moves below the computation and
    repeats it, costly parsing included. It stops at a generator, here one of
    a single element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
