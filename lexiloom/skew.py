"""Joins that hold when one key has a third of all rows.

A key is hot when it has more than one in ``SHARE`` of the rows.  There can be
at most ``SHARE`` such keys, whatever the data, so their rows of a table with
unique keys may be broadcast; all other keys go through an ordinary join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def hot_keys(counted: DataFrame, count: str, total: int) -> Column:
    """Condition on a table with one row per key: the key is hot."""
    return F.col(count) * SHARE > F.lit(total)


def join_unique(big: DataFrame, small: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of big with small, which has one row per key and the number of
    big's rows per key in ``count``.  Hot keys are joined by broadcast of at most
    SHARE rows, the rest by a shuffle in which no key is hot."""
    hot = small.where(hot_keys(small, count, total))
    cold = small.where(~hot_keys(small, count, total))
    hit = big.join(F.broadcast(hot), keys, "inner")
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "inner")
    return hit.unionByName(rest)


def join_salted(left: DataFrame, members: DataFrame, key: str, by: str, hot: DataFrame, salts: int = 64) -> DataFrame:
    """Inner join on ``key`` where members may have hot keys.  ``hot`` lists them
    (at most SHARE rows, see hot_keys).  Members of a hot key are spread over
    ``salts`` partitions by their ``by`` column and left's rows of it repeated."""
    marks = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    spread = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    one = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    a = left.join(marks, key, "left").withColumn("_salt", F.explode(spread)).drop("_hot")
    b = members.join(marks, key, "left").withColumn("_salt", one).drop("_hot")
    return a.join(b, [key, "_salt"], "inner").drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """A table that is small by the optimiser's estimate, so read by fewer tasks than there
    are cores, over all cores before costly expressions; any other is left as it is, as is
    one of as many files as there are cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores << 26 and len(df.inputFiles()) < cores else df
