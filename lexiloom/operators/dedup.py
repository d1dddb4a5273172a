"""De-duplication, component ledgers and group rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_conflict(df: DataFrame, fp: str, id: str, label: str) -> DataFrame:
    """(fp, kept_id, n, conflict): rows with equal fingerprints are one, the smallest id
    standing for them; if their labels differ, none is kept (kept_id null)."""
    g = df.groupBy(fp).agg(F.min(id).alias("least"), F.count("*").alias("n"), F.countDistinct(label).alias("labels"))
    return g.select(fp, F.when(F.col("labels") <= 1, F.col("least")).alias("kept_id"), "n", (F.col("labels") > 1).alias("conflict"))


def dedup_prefer(df: DataFrame, fp: str, prefer: Column, order: str, label: str | None = None) -> DataFrame:
    """One row per fingerprint: preferred rows first, then input order.  An aggregate
    of the smallest struct, so a hot fingerprint is combined before the shuffle.  With
    a label column, copies with different labels are an error."""
    if label:
        for row in df.groupBy(fp).agg(F.countDistinct(label).alias("n")).where("n > 1").limit(1).collect():
            raise ValueError(f"copies with different labels: {row[fp]}")
    rest = [c for c in df.columns if c != fp]
    best = df.groupBy(fp).agg(F.min_by(F.struct(*rest), F.struct((~prefer).alias("p"), F.col(order).alias("o"))).alias("b"))
    return best.select(fp, "b.*")


def ledger(members: DataFrame, id: str, root: str, fp: str, label: str) -> DataFrame:
    """Per component: group id (``g:`` and 20 digits of the SHA-256 of its sorted
    fingerprints), size, whether labels conflict, and the representative with the
    smallest (fingerprint, id), null on conflict.

    Member lists are what the ledger is about; they are collected per component.
    """
    g = members.groupBy(root).agg(F.array_sort(F.collect_list(fp)).alias("fps"), F.array_sort(F.collect_list(F.col(id).cast("string"))).alias("member_ids"), F.count("*").alias("size"), F.countDistinct(label).alias("labels"), F.min(F.struct(F.col(fp), F.col(id))).alias("least"))
    digest = F.concat(F.lit("g:"), F.substring(F.sha2(F.array_join("fps", "\n"), 256), 1, 20))
    return g.select(root, digest.alias("group_id"), "member_ids", "size", (F.col("labels") > 1).alias("label_conflict"), F.when(F.col("labels") <= 1, F.col(f"least.{id}")).alias("representative_id"))


def template_cap(df: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """At most ``cap`` rows of each group in order (the cap is the feature), with the
    size of the largest group before it."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n").alias("largest_before"))
    kept = df.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("pos") <= cap)
    return kept.join(F.broadcast(largest))


def cross_domain_removal(df: DataFrame, group: str, domain: str, home: str = "S") -> DataFrame:
    """Rows kept: of a group in several domains only the home domain's rows."""
    mixed = df.groupBy(group).agg(F.countDistinct(domain).alias("domains")).where("domains > 1").select(group)
    foreign = df.where(~F.col(domain).eqNullSafe(home)).join(mixed, group, "left_semi").select("id")
    return df.join(foreign, "id", "left_anti")


def template_concentration(df: DataFrame, source: str, label: str, group: str) -> DataFrame:
    """Per source and label: rows, groups, the largest group and its share."""
    g = df.groupBy(source, label, group).agg(F.count("*").alias("m"))
    return g.groupBy(source, label).agg(F.sum("m").alias("rows"), F.count("*").alias("groups"), F.max("m").alias("largest"), (F.max("m") / F.sum("m")).alias("largest_share"))


def leaks(df: DataFrame, key: str, split: str, train: str = "train") -> DataFrame:
    """Keys that a split shares with training: (split, shared); empty when disjoint."""
    taught = df.where(F.col(split) == train).select(key).distinct()
    return df.where(F.col(split) != train).select(key, split).distinct().join(taught, key, "left_semi").groupBy(split).agg(F.count("*").alias("shared"))


def partition_violations(df: DataFrame, id: str, text_fp: str, label: str, split: str) -> DataFrame:
    """(split, problem) for splits without both labels or with a repeated fingerprint."""
    g = df.groupBy(split).agg(F.countDistinct(label).alias("labels"))
    d = df.groupBy(split, text_fp).agg(F.count("*").alias("n")).where("n > 1").select(split).distinct()
    return g.where("labels < 2").select(split, F.lit("one label").alias("problem")).unionByName(d.select(split, F.lit("repeated text").alias("problem")))


def spanning_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")
