"""Same or near-same records across splits (problem 5).

Records are canonicalised and hashed (canon.py).  Every distinct hash carries
whether it occurs in training and in evaluation splits; evaluation hashes are
joined with training hashes, directly and through the near-duplicate pairs of
neardup.py, and the hits go back to the evaluation rows.

Defined results: splits are compared without blanks around them and in lower
case, ``val`` and ``dev`` being validation; other values are no split.  A null id
is no record; a repeated id counts under every split it was delivered in; texts
without words overlap nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..skew import join_unique
from .editdup import NearCopies


def split_name(column: Column) -> Column:
    """train, validation or test; null for anything else."""
    s = F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", ""))
    return F.when(s.isin("val", "dev", "validation"), "validation").when(s.isin("train", "test"), s)


def source_name(column: Column) -> Column:
    """Plain spelling of a source: lower case, hyphens, no blanks around it; null if empty."""
    s = F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", "")), "_", "-")
    return F.when(s != "", s)


class SplitOverlap:
    def __init__(self, df: DataFrame, id: str, text: str, split: str, extra: list[str] | None = None) -> None:
        near = NearCopies(df, id, text, [split, *(extra or [])])
        self.scratch, self.n_rows = near.scratch, near.n_rows
        rows = near.copies.rows.where("n_words > 0").withColumn("split", split_name(F.col(split)))
        self.rows = rows.where("split is not null")
        # one row per word sequence: partial aggregation takes care of hot texts; exact
        # overlaps go by 128-bit hashes, ``w`` is the key of near-duplicates
        forms = self.rows.groupBy("words", "w").agg(F.bool_or(F.col("split") == "train").alias("trained"), F.sum(F.when(F.col("split") != "train", 1).otherwise(0)).alias("n"))
        kept = near.copies.classes.groupBy("words").agg(F.min("kept_id").alias("kept"))
        forms = self.scratch.keep(forms.join(kept, "words", "left"))
        taught = forms.where("trained")
        classes = taught.where("kept is not null").select("kept").distinct().withColumn("copied", F.lit(True))
        both = near.near.select("key_a", "key_b").union(near.near.select("key_b", "key_a")).toDF("w", "other")
        # a near-duplicate of a text is one of all its copies too: their words are the same
        close = both.join(taught.select(F.col("w").alias("other")), "other").select("w").distinct().withColumn("near", F.lit(True))
        hits = forms.where("n > 0").join(close, "w", "left").join(classes, "kept", "left")
        self.hits = self.scratch.keep(hits.select("words", "n", (F.col("trained") | F.coalesce("copied", F.lit(False))).alias("exact"), F.coalesce("near", F.lit(False)).alias("near")).where("exact or near"))

    def found(self) -> DataFrame:
        """Evaluation rows with an overlap: the rows' columns, exact and near."""
        return join_unique(self.rows.where("split <> 'train'"), self.hits, ["words"], "n", self.n_rows)

    def ids(self) -> DataFrame:
        return self.found().select("id").distinct()

    def report(self, source: str) -> DataFrame:
        """Records in each evaluation split and source, and how many of them occur in
        training exactly, nearly, and at all."""
        by = ["split", "source"]
        named = lambda df: df.withColumn("source", F.coalesce(source_name(F.col(source)), F.lit("(none)")))
        total = named(self.rows.where("split <> 'train'").drop("source") if source != "source" else self.rows.where("split <> 'train'")).groupBy(*by).agg(F.countDistinct("id").alias("records"))
        hit = named(self.found()).groupBy(*by, "id").agg(F.bool_or("exact").alias("exact"), F.bool_or("near").alias("near"))
        counted = hit.groupBy(*by).agg(F.count_if("exact").alias("exact_records"), F.count_if(F.col("near") & ~F.col("exact")).alias("near_records"), F.count("*").alias("overlapping_records"))
        zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("exact_records", "near_records", "overlapping_records")]
        return total.join(counted, by, "left").select(*by, "records", *zero)
