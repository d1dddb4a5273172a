"""Sample matching target category proportions (problem 3): divisor-method priorities.

Records of a category are ranked at random (by a seeded hash of their key).  A
record's priority is (rank - 1/2) / target; the ``min_rows`` first records of every
category come before all others, and of the rest the globally smallest priorities
are kept until the sample is full.  A category that runs out stops giving
priorities, so its seats go to the others by themselves.

Ranks are dense within a category although a category may hold a third of all
rows: records fall into slices of the hash range of about SLICE_ROWS records each, ranks
are counted within a slice and the sizes of the slices before it are added.  As the ranks of a
category of n records are 1..n, the size of every category alone gives the
priority at which the sample is full: no rows are sorted globally.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..scratch import Scratch

#: Records of a slice, about.
SLICE_ROWS = 100_000
#: Categories that a target set may have.
MOST_CATEGORIES = 100_000


def seats(sizes: dict[str, int], shares: dict[str, float], floors: dict[str, int], n: int) -> dict[str, int]:
    """Records to take of every category: the floors first (as far as records go,
    in category order if even these exceed n), then the smallest priorities."""
    taken: dict[str, int] = {}
    left = n
    for c in sorted(shares):
        taken[c] = min(sizes.get(c, 0), max(0, floors.get(c, 0)), left)
        left -= taken[c]
    exact = {c: Fraction(s).limit_denominator(10**12) for c, s in shares.items() if s > 0}

    def upto(x: Fraction) -> dict[str, int]:
        return {c: max(taken[c], min(sizes.get(c, 0), int(x * t + Fraction(1, 2)))) for c, t in exact.items()}

    base = sum(taken[c] for c in shares if c not in exact)
    room = sum(max(taken[c], sizes.get(c, 0)) for c in exact)
    want = min(n - base, room)
    low, high = Fraction(0), Fraction(1)
    while sum(upto(high).values()) < want:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if sum(upto(mid).values()) < want:
            low = mid
        else:
            high = mid
        if high - low < Fraction(1, 10**9):
            break
    result = {**taken, **upto(low)}
    # the priorities between low and high are equal: ties go in category order
    for c in sorted(exact):
        if sum(result.values()) < base + want and upto(high)[c] > result[c]:
            result[c] += 1
    return result


class TargetSample:
    """A sample of ``n`` records whose categories follow ``targets``.

    ``targets``: (category, share, min_rows), one row per category; a repeated
    category counts once (largest share), null categories and shares are left out.
    Defined results: a null key or category is not eligible; a repeated key is one
    record with its smallest category; an n above the eligible records takes all.
    """

    def __init__(self, records: DataFrame, key: str, category: str, targets: DataFrame, n: int | None = None, fraction: float = 0.1, seed: str = "sample") -> None:
        self.scratch = Scratch(records.sparkSession)
        wanted = targets.where("category is not null and share is not null").groupBy("category").agg(F.max("share").alias("share"), F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows")).limit(MOST_CATEGORIES + 1).collect()
        if len(wanted) > MOST_CATEGORIES:
            raise ValueError(f"more than {MOST_CATEGORIES} categories")
        self.shares = {r.category: float(r.share) for r in wanted}
        self.floors = {r.category: int(r.min_rows) for r in wanted}
        spark = records.sparkSession
        self.targets = spark.createDataFrame([(c, self.shares[c], self.floors[c]) for c in sorted(self.shares)], "category string, share double, min_rows bigint")
        one = records.select(F.col(key).alias("key"), F.col(category).alias("category")).where("key is not null and category is not null").groupBy("key").agg(F.min("category").alias("category"))
        draw = rng.draw(seed, "key")
        eligible = one.join(F.broadcast(self.targets.select("category")), "category", "left_semi").withColumn("draw", draw)
        self.rows = self.scratch.keep(eligible)
        slices = max(1, self.rows.count() // SLICE_ROWS)
        self.rows = self.rows.withColumn("slice", F.floor(rng.number(F.col("draw")) / F.lit(2**32 / slices)).cast("int"))
        self.sliced = self.rows.groupBy("category", "slice").agg(F.count("*").alias("n"))
        self.sizes = {r.category: r.n for r in self.sliced.groupBy("category").agg(F.sum("n").alias("n")).collect()}
        total = sum(self.sizes.values())
        self.n = min(total, int(total * fraction) if n is None else n)
        self.seats = seats(self.sizes, self.shares, self.floors, self.n)

    def sample(self) -> DataFrame:
        """(key, category, rank, priority) of the records drawn."""
        before = Window.partitionBy("category").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        offset = self.sliced.select("category", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        spark = self.rows.sparkSession
        plan = spark.createDataFrame([(c, self.shares[c], self.floors[c], self.seats[c]) for c in sorted(self.shares)], "category string, share double, min_rows bigint, seats bigint")
        # slices that lie wholly behind the last seat need no ranking
        opened = offset.join(F.broadcast(plan), "category").where("offset < seats")
        ranked = self.rows.join(opened, ["category", "slice"]).withColumn("rank", F.row_number().over(Window.partitionBy("category", "slice").orderBy("draw", "key")) + F.col("offset"))
        priority = F.when(F.col("rank") <= F.col("min_rows"), F.lit(0.0)).otherwise((F.col("rank") - F.lit(0.5)) / F.col("share"))
        return ranked.where("rank <= seats").select("key", "category", "rank", priority.alias("priority"))

    def report(self) -> DataFrame:
        """One row per category: target, records available and drawn, the share drawn,
        whether its minimum was met, and by how many records it falls short of its
        share (of the whole sample, rounded down); 0 where the target was met."""
        spark = self.rows.sparkSession
        drawn = sum(self.seats.values())
        rows = []
        for c in sorted(self.shares):
            have, got, want = self.sizes.get(c, 0), self.seats[c], int(self.shares[c] * drawn + 1e-9)
            rows.append((c, self.shares[c], self.floors[c], have, got, got / drawn if drawn else None, got >= self.floors[c], max(0, want - got)))
        return spark.createDataFrame(rows, "category string, share double, min_rows bigint, available bigint, sampled bigint, sampled_share double, min_met boolean, short_by bigint")
