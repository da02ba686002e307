"""Running values over long ordered groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    previous: dict[str, str],
    running: dict[str, Column],
) -> DataFrame:
    """Previous row's values and running sums per key.

    ``previous`` maps new columns to the column whose previous value they
    hold; ``running`` maps new columns to the expression they sum up to and
    including the row. ``block`` cuts the order into consecutive pieces (the
    hour of a timestamp, say) and must not decrease along ``order``.

    A window per key would put a key that holds a third of all rows into one
    task. Here the rows are windowed per key *and block*, after one exchange.
    What a block passes on is a plain aggregation, summed within tasks before
    it moves; only its rows, one per key and block, are windowed per key. The
    join back uses the partitioning the rows already have.
    """
    # A struct is never NULL itself, so that rows with a NULL key stay in the join.
    blocked = rows.withColumn("_key", F.struct(*keys)).withColumn(
        "_place", F.struct("_key", block.alias("block"))
    )
    state = F.struct(*[F.col(c).alias(new) for new, c in previous.items()])
    inside = Window.partitionBy("_place").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = blocked.withColumns(
        {
            "_lag": F.lag(state).over(inside),
            **{f"_run_{new}": F.sum(value).over(so_far) for new, value in running.items()},
        }
    )
    over_blocks = Window.partitionBy("_key").orderBy("_place.block")
    earlier = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("_place").agg(
        F.max_by(state, F.struct(*order)).alias("_state"),
        *[F.sum(value).alias(f"_sum_{new}") for new, value in running.items()],
    ).withColumn("_key", F.col("_place._key"))
    handed_on = blocks.select(
        "_place",
        F.lag("_state").over(over_blocks).alias("_carry"),
        *[
            F.coalesce(F.sum(f"_sum_{new}").over(earlier), F.lit(0)).alias(f"_before_{new}")
            for new in running
        ],
    )
    joined = local.join(handed_on, "_place")
    before = F.coalesce("_lag", "_carry")
    return joined.select(
        *rows.columns,
        *[before[new].alias(new) for new in previous],
        *[(F.col(f"_before_{new}") + F.col(f"_run_{new}")).alias(new) for new in running],
    )
