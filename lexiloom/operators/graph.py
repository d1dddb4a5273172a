"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .similarity import containment_links

MAX_ROUNDS = 200


def containment_components(sh: DataFrame, cutoff: float = 0.5, min_shared: int = 3) -> DataFrame:
    """(id, root) of every row of a table of shingles or shingle sets: the components of
    containment_edges, found over the different sets; root is the smallest row."""
    edges, member = containment_links(sh, cutoff, min_shared)
    roots = components(edges).select(F.col("id").alias("first"), "root")
    return member.join(roots, "first", "left").select("id", F.coalesce("root", "first").alias("root"))


def components(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(id, root) of every vertex of the edges; root is the smallest vertex of its
    component.  Null ends are no edges; no edges give no rows.

    Each round every vertex takes the smallest root among itself and its neighbours,
    then the root of that root, so paths shorten geometrically.  Labels are written
    to the shared folder each round, which cuts the lineage.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = scratch.keep(pairs.union(pairs.select("y", "x")).distinct())
    labels = scratch.keep(edges.select(F.explode(F.array(a, b)).alias("id")).where("id is not null").distinct().withColumn("root", F.col("id")))
    state = None
    for _ in range(MAX_ROUNDS):
        heard = both.join(labels, both.y == labels.id).groupBy("x").agg(F.min("root").alias("heard"))
        least = labels.join(heard, labels.id == heard.x, "left").select("id", "root", F.least("root", F.coalesce("heard", "root")).alias("near"))
        # the old root learns of a smaller one too, then everyone jumps
        taught = least.groupBy(F.col("root").alias("r")).agg(F.min("near").alias("taught"))
        hooked = least.join(taught, least.root == taught.r).select("id", F.least("near", "taught").alias("root"))
        jump = hooked.select(F.col("id").alias("p"), F.col("root").alias("to"))
        fresh = scratch.keep(hooked.join(jump, hooked.root == jump.p).select("id", F.col("to").alias("root")))
        scratch.drop(labels)
        labels, before = fresh, state
        h = F.xxhash64("id", "root")
        state = tuple(labels.agg(F.count("*"), F.bit_xor(h), F.sum(F.hash("root", "id").cast("long"))).first())
        if state == before:
            return labels
    raise RuntimeError("components did not become stable")
