"""Near-duplicate records and their groups (problem 2) on top of neardup.py.

Defined results: a null id is no record; a repeated id is one record; texts
without words have no near-duplicates; copies in the sense of formatdup.py are
no near-duplicate pairs but lie in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..skew import SHARE as HOT, join_salted
from .components import hash_to_min
from .formatdup import LayoutCopies
from .neardup import near_pairs


class NearCopies:
    """Near-duplicates and copies among the records of a table."""

    def __init__(self, df: DataFrame, id: str, text: str, extra: list[str] | None = None) -> None:
        self.scratch = Scratch(df.sparkSession)
        self.copies = LayoutCopies(df, id, text, self.scratch, extra)
        wordy = df.where(F.col(id).isNotNull()).select(F.col(text).alias("text"))
        self.n_rows = self.copies.rows.count()
        self.members = self.copies.rows.where("n_words > 0").select("id", F.col("w").alias("key")).distinct()
        self.near = self._without_copies(near_pairs(wordy, "text", self.n_rows, self.copies.repeats.select(F.col("w").alias("key")).distinct(), self.scratch))

    def classes(self) -> DataFrame:
        """(key, kept) for the word sequences whose text has copies."""
        return self.copies.classes.groupBy(F.col("w").alias("key")).agg(F.min("kept_id").alias("kept"))

    def _without_copies(self, near: DataFrame) -> DataFrame:
        kept = self.scratch.keep(self.classes())
        named = lambda x: kept.select(F.col("key").alias(f"key_{x}"), F.col("kept").alias(f"kept_{x}"))
        both = near.join(named("a"), "key_a", "left").join(named("b"), "key_b", "left")
        return self.scratch.keep(both.where("kept_a is null or kept_b is null or kept_a <> kept_b").select("key_a", "key_b"))

    def pairs(self) -> DataFrame:
        """(id_a, id_b): all pairs of near-duplicate records, the smaller id first."""
        hot = self.copies.classes.groupBy(F.col("w").alias("key")).agg(F.sum("n").alias("n")).where(F.col("n") * HOT > self.n_rows).select("key")
        side = lambda x: self.members.select(F.col("key").alias(f"key_{x}"), F.col("id").alias(f"id_{x}"))
        one = join_salted(self.near, side("a"), "key_a", "id_a", hot.withColumnRenamed("key", "key_a"))
        two = join_salted(one, side("b"), "key_b", "id_b", hot.withColumnRenamed("key", "key_b"))
        return two.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, group_id) of every record with words: records linked by copies and
        near-duplicates, directly or not, share a group.  The group id is ``g:`` and
        20 hex digits of the SHA-256 of the group's smallest id."""
        least = self.members.groupBy("key").agg(F.min("id").alias("least"))
        kept = self.scratch.keep(least.join(self.classes(), "key", "left").select("key", F.coalesce("kept", "least").alias("node")))
        end = lambda x: kept.select(F.col("key").alias(f"key_{x}"), F.col("node").alias(x))
        roots = hash_to_min(self.near.join(end("a"), "key_a").join(end("b"), "key_b"), scratch=self.scratch)
        whole = kept.join(roots.withColumnRenamed("id", "node"), "node", "left").select("key", F.coalesce("group_id", "node").alias("root"))
        named = self.members.join(whole, "key")
        return named.select("id", F.concat(F.lit("g:"), F.substring(F.sha2("root", 256), 1, 20)).alias("group_id"))
