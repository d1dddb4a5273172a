"""Leakage-free pools: de-duplicate, group, remove cross-domain rows, allocate; and the
fixed-point curation of a small corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import Scratch
from . import charcosine as C, dedup as D, graph as G, sampling as S, similarity as X

FRACTIONS = {"S-train": 0.55, "S-cal": 0.25, "S-generic-bank": 0.05, "S-test": 0.15}


def build_pools(rows: DataFrame, seed: str = "pools", bank_benign: int = 1000, fractions: dict[str, float] | None = None) -> DataFrame:
    """(id, text, label, source, domain, sha, group, partition) of the rows that stay.

    ``rows``: (id, text, label, source, domain in S, T, U).  Exact copies become one row,
    copies with different labels none; rows whose word shingles contain each other form
    groups; a group in several domains keeps its S rows; S groups are allocated, T groups
    fill the bank and else evaluate, U groups evaluate; positives of the bank are apart.
    """
    scratch = Scratch(rows.sparkSession)
    marked = scratch.keep(rows.withColumn("sha", T.fp_nfkc(F.col("text"))))
    kept = D.dedup_conflict(marked, "sha", "id", "label").where("kept_id is not null").select(F.col("kept_id").alias("id"))
    rows = scratch.keep(marked.join(kept, "id", "left_semi"))
    scratch.drop(marked)
    roots = G.containment_components(X.shingle_sets(rows, "id", T.normalized(F.col("text"))))
    grouped = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = D.ledger(grouped, "id", "root", "sha", "label").select("root", F.col("group_id").alias("group"))
    grouped = scratch.keep(D.cross_domain_removal(grouped.join(names, "root").drop("root"), "group", "domain"))
    scratch.drop(rows)
    sizes = lambda domain: S.group_sizes(grouped.where(F.col("domain") == domain), "group", "label")
    placed = S.allocate_groups(sizes("S"), "group", fractions or FRACTIONS, seed)
    bank = S.bank_fill(sizes("T"), "group", seed, bank_benign).where("in_bank").select("group")
    target = sizes("T").select("group").join(bank.withColumn("b", F.lit(True)), "group", "left").select("group", F.when(F.col("b"), "T-bank").otherwise("T-eval").alias("partition"))
    placed = placed.unionByName(target).unionByName(sizes("U").select("group", F.lit("U-eval").alias("partition")))
    out = grouped.join(placed.groupBy("group").agg(F.max("partition").alias("partition")), "group")
    return out.withColumn("partition", F.when((F.col("partition") == "T-bank") & (F.col("label") == 1), "T-bank-discarded-positive").otherwise(F.col("partition")))


def disjoint(candidates: DataFrame, evaluation: DataFrame, attacks: DataFrame, id: str = "id", text: str = "text", semantic: float = 0.92) -> tuple[DataFrame, dict[str, int]]:
    """Candidates that share no text with evaluation or attack rows, and how many remain
    after each step: containment, containment, character TF-IDF, own near-duplicates."""
    scratch = Scratch(candidates.sparkSession)
    counts = {"candidates": candidates.count()}
    normal = T.lowered(F.col(text))
    left = candidates
    for name, other in (("evaluation", evaluation), ("attacks", attacks)):
        hits = X.cross_edges(X.shingle_sets(left, id, normal), X.shingle_sets(other, id, normal)).select(F.col("i").alias(id)).distinct()
        left = scratch.keep(left.join(hits, id, "left_anti"))
        counts[name] = left.count()
    reference = evaluation.select(id, text).unionByName(attacks.select(id, text))
    far = semantic_far(left, reference, id, text, semantic)
    left = scratch.keep(far)
    counts["semantic"] = left.count()
    roots = G.containment_components(X.shingle_sets(left, id, normal))
    left = scratch.keep(left.join(roots.withColumnRenamed("id", id), id, "left").where(F.col("root").isNull() | (F.col("root") == F.col(id))).drop("root"))
    counts["distinct"] = left.count()
    return left, counts


def semantic_far(df: DataFrame, reference: DataFrame, id: str, text: str, cutoff: float = 0.92, terms: int = 12_000) -> DataFrame:
    """Rows whose largest character TF-IDF cosine (3-4 grams, sublinear, vocabulary of
    both sides) to a reference row is below the cutoff; all rows if there are none."""
    a, b = (C.texts_of(x.select(F.col(id).cast("string").alias("k"), text), "k", F.lower(F.col(text))) for x in (df, reference))
    hits = C.cosine_pairs(a, b, cutoff, 3, 4, terms, once=True).select(F.col("i").alias("k")).distinct()
    return df.withColumn("k", F.col(id).cast("string")).join(hits, "k", "left_anti").drop("k")


def curate(rows: DataFrame, seeds: Sequence[str] = ("1", "2"), cosine: float = 0.9, edit: float = 0.9, terms: int = 50_000, rounds: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(retained, ledger, edges) at the fixed point.

    Edges: equal normal forms, character TF-IDF cosine (raw and normalised), edit ratio.
    Then components collapse to representatives (label conflicts are quarantined), every
    seed splits the representatives, and pairs that the split's own vocabulary finds
    across splits become edges, until none is new.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    rows = scratch.keep(rows.withColumn("norm", T.normalized(F.col("text"))).withColumn("fp", F.sha2("norm", 256)))
    first = rows.groupBy("fp").agg(F.min("id").alias("i"))
    edges = rows.join(first, "fp").where("id <> i").select("i", F.col("id").alias("j"))
    for column in ("text", "norm"):
        counts = X.char_wb(rows, "id", F.lower(column), 3, 5)
        v = X.tfidf(counts, counts, terms, sublinear=False)
        edges = edges.unionByName(X.cosine_pairs(v, v, cosine, self_join=True).select("i", "j"))
    edges = scratch.keep(edges.unionByName(X.edit_pairs(rows, "id", F.col("norm"), edit).select("i", "j")).distinct())
    for _ in range(rounds):
        roots = G.components(edges)
        grouped = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        book = scratch.keep(D.ledger(grouped, "id", "root", "fp", "label"))
        retained = scratch.keep(rows.join(book.where("representative_id is not null").select(F.col("representative_id").alias("id")), "id", "left_semi"))
        fresh = spark.createDataFrame([], "i string, j string")
        for seed in seeds:
            split = scratch.keep(retained.join(S.stratified_split(retained, "id", "label", seed).select("id", "split"), "id"))
            for reference, query in ((("train",), "validation"), (("train", "validation"), "test")):
                r, q = split.where(F.col("split").isin(*reference)), split.where(F.col("split") == query)
                for column in ("text", "norm"):
                    fit = X.char_wb(r, "id", F.lower(column), 3, 5)
                    asked = X.tfidf(X.char_wb(q, "id", F.lower(column), 3, 5), fit, terms, sublinear=False)
                    pairs = X.cosine_pairs(asked, X.tfidf(fit, fit, terms, sublinear=False), cosine)
                    fresh = fresh.unionByName(pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")))
        more = scratch.keep(fresh.distinct().join(edges, ["i", "j"], "left_anti"))
        if not more.take(1):
            return retained, book, edges
        edges = scratch.keep(edges.unionByName(more))
    raise RuntimeError("curation did not settle")
