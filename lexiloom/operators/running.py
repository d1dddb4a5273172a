"""Ranks and running sums in an order, without a window that spans all rows.

A window over few or hot groups is one task for a third of the rows.  Here rows are
range partitioned by group and order; windows run within a group's rows of one
partition, and what the partitions before hold of the group is added from a table with
at most two rows for each partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], by: Sequence[str] = (), totals: dict[str, str] | None = None) -> DataFrame:
    """The rows with, for each name of ``sums``, the sum of its value over the rows of the
    same ``by`` up to and with this one, in ``order``; ``totals`` (name to name of sums)
    adds the sum over all rows of the group.

    ``order`` should be unique within ``by``; ties stand in any order, but in one for all
    sums of a call.  Null values count as 0.
    """
    scratch, totals = Scratch(df.sparkSession), totals or {}
    values = {f"_v{k}": F.coalesce(v, F.lit(0)) for k, v in enumerate(sums.values())}
    keys = [f"_k{k}" for k in range(len(by))]
    ahead = df.withColumns({**values, **{k: F.col(b) for k, b in zip(keys, by)}})
    ranged = ahead.repartitionByRange(*keys, *order) if keys or order else ahead
    held = scratch.keep(ranged.withColumn("_part", F.spark_partition_id()))
    each = held.groupBy(*keys, "_part").agg(*[F.sum(v).alias(v) for v in values])
    # groups that lie in several partitions: at most two rows a partition
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    several = F.count("*").over(whole)
    carry = {f"_b{v}": F.coalesce(F.sum(v).over(upto), F.lit(0)) for v in values} | {f"_t{v}": F.sum(v).over(whole) for v in values}
    carried = each.withColumns({**carry, "_several": several}).where("_several > 1").drop("_several", *values)
    on = [F.col(f"h.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys] + [F.col("h._part") == F.col("c._part")]
    both = held.alias("h").join(F.broadcast(carried.alias("c")), on, "left").select("h.*", *[f"c.{c}" for c in carry])
    here = Window.partitionBy("_part", *keys)
    line = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = dict(zip(sums, values))
    out = {n: F.sum(v).over(line) + F.coalesce(F.col(f"_b{v}"), F.lit(0)) for n, v in at.items()}
    out |= {t: F.coalesce(F.col(f"_t{at[n]}"), F.sum(at[n]).over(here)) for t, n in totals.items()}
    return both.withColumns(out).drop("_part", *keys, *values, *carry)


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "r", total: str | None = None) -> DataFrame:
    """The rows with their rank from 1 within ``by`` (a bigint), and the group's size."""
    return running(df, order, {name: F.lit(1).cast("bigint")}, by, {total: name} if total else None)
