"""Groups from pairwise matches (problem 1): Hash-to-Min.

Every vertex v has a cluster set, at first itself and its neighbours.  In a round v
sends the set to its smallest member and that member to all others; the new set is
v and what it received.  At the fixed point the smallest vertex of a component holds
the whole component and every other vertex holds itself and the smallest.

* What a round sends is symmetric: x receives y exactly when y receives x.  So the
  sets are rows (lo, hi), one for each two vertices that hold each other, never a
  cell; the smallest member of v's set is the smallest lo of the rows with hi = v.
* A component is finished when its rows are a star: all hang on a vertex without
  smaller ones, and none of the others has a second row.  Finished components leave
  the rounds at once, so a round costs what is still open.
* Hot vertices get their row of the vertex table by a broadcast that is bounded by
  skew.SHARE rows, all others by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import join_unique

#: Rounds after which something is wrong: the depth of a path of 2**60 vertices.
MAX_ROUNDS = 200


def matches(lines: DataFrame, left: str = "left_id", right: str = "right_id", score: str = "cosine", least: float = 0.85) -> DataFrame:
    """The lines that are matches, as (a, b) with a < b: both ids there and different,
    the score a number (not null, not NaN) of at least ``least``.  Repeated lines and
    swapped sides give equal rows, which hash_to_min takes for one."""
    ok = F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)) & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & (F.col(score) >= F.lit(least))
    return lines.where(ok).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))


def hash_to_min(pairs: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """Component of every vertex of the pairs: (id, group_id), group_id being the
    smallest vertex of the component.

    Pairs with a null end are no links; a pair of a vertex with itself gives a
    component of one.  No pairs give no rows.  Other columns are ignored.
    """
    scratch = scratch or Scratch(pairs.sparkSession)
    ends = pairs.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = scratch.keep(ends.distinct())
    # a vertex with itself is a row only until its component is known
    alone = rows.where("lo = hi").select(F.col("lo").alias("id"), F.col("lo").alias("group_id"))
    n_alone = alone.count()
    rows = rows.where("lo < hi")
    labels, vertices = [], None
    for _ in range(MAX_ROUNDS):
        n = rows.count()
        if not n:
            break
        sent, found, vertices = _round(rows, n, vertices, scratch)
        labels.append(found)
        scratch.drop(rows)
        rows = sent
    else:
        raise RuntimeError("Hash-to-Min did not become stable")
    out = labels[0] if labels else alone.limit(0)
    for found in labels[1:]:
        out = out.unionByName(found)
    return out.unionByName(alone.join(out.select("id"), "id", "left_anti")) if n_alone else out


def _round(rows: DataFrame, n: int, before: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the components still open after a round, (id, group_id) of the others, and
    the vertices with their smallest members, which hold themselves in the next round.
    ``before``: the vertices of the round before."""
    below = rows.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"), F.count("*").alias("smaller"))
    above = rows.groupBy(F.col("lo").alias("v")).agg(F.count("*").alias("larger"))
    vertices = below.join(above, "v", "full")
    if before is None:
        vertices = scratch.keep(vertices.withColumn("own", F.lit(True)))
    else:
        minima = before.where("m is not null").select(F.col("m").alias("v"), F.lit(True).alias("own")).distinct()
        vertices = scratch.keep(vertices.join(minima, "v", "left"))
        scratch.drop(before)
    leaves = vertices.where("smaller = 1 and larger is null").groupBy(F.col("m").alias("v")).agg(F.count("*").alias("leaves"))
    stars = vertices.where("m is null").join(leaves, "v").where("larger = leaves").select("v", F.lit(True).alias("star"))
    of_lo = vertices.where("larger is not null").join(stars, "v", "left").select(F.col("v").alias("lo"), F.coalesce("m", "v").alias("ml"), "star", "larger")
    told = scratch.keep(join_unique(rows, of_lo, ["lo"], "larger", n).select("lo", "hi", "ml", "star"))
    # of a star, the row of its smallest vertex with itself comes from any of its rows
    star = told.where("star").select("lo").distinct().select(F.col("lo").alias("id"), F.col("lo").alias("group_id"))
    found = told.where("star").select(F.col("hi").alias("id"), F.col("lo").alias("group_id")).unionByName(star)
    left = told.where("star is null")
    of_hi = vertices.where("m is not null").select(F.col("v").alias("hi"), "m", "own", "smaller")
    known = join_unique(left, of_hi, ["hi"], "smaller", n)
    # hi gets the smallest of lo's set, lo that of hi's; in hi's row of its smallest that vertex gets hi, if hi holds itself
    back = F.when(F.col("lo") != F.col("m"), F.col("lo")).when(F.col("own"), F.col("hi"))
    sent = known.select(F.explode(F.array(F.struct(F.col("ml").alias("x"), F.col("hi").alias("y")), F.struct(F.col("m").alias("x"), back.alias("y")))).alias("s")).select("s.x", "s.y").where("x <> y")
    fresh = scratch.keep(sent.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
    # a vertex without smaller ones holds itself in any case
    return fresh, found, vertices
