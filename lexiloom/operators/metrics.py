"""Threshold and ranking metrics over score tables.

Rows are pre-aggregated per distinct score (and per ``by`` columns: model, cell,
replicate) before any running sum, so that tie blocks need no special care.  Undefined values are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running

#: Slack by which an allowed count or rate may be missed through rounding.
SLACK = 1e-12
Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def per_score(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., score, pos, neg): weighted positives and negatives of each score; rows
    without score or label are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ok = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull()
    return df.where(ok).groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(w)).alias("neg"))


def ranked(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative positives and negatives at each score, from the highest, and totals."""
    return running(blocks, [F.desc("score")], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, by, {"all_pos": "cum_pos", "all_neg": "cum_neg"})


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p, zz = k / n, F.lit(z * z)
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def confusion(flag: Column, label: Column) -> dict[str, Column]:
    """Aggregates: counts, precision, recall, F1 (0 where undefined) and FPR (null)."""
    c = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    tp, fp = c(flag & (label == 1)), c(flag & (label == 0))
    fn, tn = c(~flag & (label == 1)), c(~flag & (label == 0))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)}


def confusion_metrics(df: DataFrame, score: str, label: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    t = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    parts = confusion(F.col(score) >= t, F.col(label))
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in parts.items()])


def slice_metrics(df: DataFrame, score: str, label: str, threshold: float, source: str, family: str) -> DataFrame:
    """Confusion metrics overall, per source and per family ('unknown' if null) in one
    pass with grouping sets."""
    flat = df.select(F.col(score).alias("s"), F.col(label).alias("y"), F.col(source).alias("source"), F.coalesce(F.col(family), F.lit("unknown")).alias("family"))
    parts = confusion(F.col("s") >= threshold, F.col("y"))
    sets = flat.groupingSets([[], ["source"], ["family"]], "source", "family")
    kind = F.when(F.grouping_id() == 3, "all").when(F.grouping_id() == 1, "source").otherwise("family")
    out = sets.agg(kind.alias("slice"), F.count("*").alias("n"), *[v.alias(k) for k, v in parts.items()])
    return out.select("slice", F.when(F.col("slice") == "all", "").otherwise(F.coalesce("source", "family")).alias("value"), "n", *parts)


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Tie-aware (weighted) area under the ROC curve; null if a class is empty."""
    r = ranked(per_score(df, score, label, by, weight), by)
    below = F.col("all_neg") - F.col("cum_neg")
    return r.groupBy(*by).agg(ratio(F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.first("all_pos") * F.first("all_neg")).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Step integral of precision over recall; null if a class is empty."""
    r = ranked(per_score(df, score, label, by), by)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return r.groupBy(*by).agg(F.when(F.first("all_neg") > 0, ratio(F.sum(step), F.first("all_pos"))).alias("average_precision"))


def select_threshold(df: DataFrame, score: str, label: str, budget: float, by: Sequence[str] = ()) -> DataFrame:
    """Among all scores and "no alert", the threshold with FPR within the budget and the
    largest (recall, -FPR, threshold).  ``strict`` tells that scores must exceed the
    threshold: the no-alert threshold lies just above the largest score."""
    r = ranked(per_score(df, score, label, by), by)
    cand = r.select(*by, F.col("score").alias("threshold"), F.lit(False).alias("strict"), F.coalesce(ratio(F.col("cum_pos"), F.col("all_pos")), F.lit(0.0)).alias("recall"), F.coalesce(ratio(F.col("cum_neg"), F.col("all_neg")), F.lit(0.0)).alias("fpr"))
    none = r.groupBy(*by).agg(F.max("score").alias("threshold")).select(*by, "threshold", F.lit(True).alias("strict"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("fpr"))
    best = cand.unionByName(none).where(F.col("fpr") <= F.lit(budget))
    return best.groupBy(*by).agg(F.max(F.struct("recall", (-F.col("fpr")).alias("minus_fpr"), "threshold", "strict")).alias("b")).select(*by, "b.threshold", "b.strict", "b.recall", (-F.col("b.minus_fpr")).alias("fpr"))


def benign_threshold(df: DataFrame, score: str, label: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, strict, n): scores above the (floor(alpha n) + 1)-th largest
    benign score are flagged; threshold 0 and not strict where every score is allowed."""
    r = ranked(per_score(df.where(F.col(label) == 0), score, label, by), by)
    allowed = F.floor(F.lit(alpha) * F.col("all_neg") + SLACK)
    at = r.groupBy(*by).agg(F.max(F.when(F.col("cum_neg") > allowed, F.col("score"))).alias("t"), F.first("all_neg").cast("bigint").alias("n"))
    return at.select(*by, F.coalesce("t", F.lit(0.0)).alias("threshold"), F.col("t").isNotNull().alias("strict"), "n")


def recall_at_fpr(df: DataFrame, score: str, label: str, alpha: float, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Largest recall with FPR <= alpha over tie blocks; null if a class is empty."""
    r = ranked(per_score(df, score, label, by, weight), by)
    fpr = F.col("cum_neg") / F.col("all_neg")
    ok = F.when((F.col("all_neg") > 0) & (F.col("all_pos") > 0), F.when(fpr <= alpha + SLACK, F.col("cum_pos") / F.col("all_pos")).otherwise(0.0))
    return r.groupBy(*by).agg(F.max(ok).alias("recall"))


def recall_by_source(df: DataFrame, score: str, label: str, source: str, alpha: float) -> DataFrame:
    """Recall of each source's positives at the cutoff of all benign rows."""
    cut = benign_threshold(df, score, label, alpha)
    flag = F.when(F.col("strict"), F.col(score) > F.col("threshold")).otherwise(F.col(score) >= F.col("threshold"))
    return df.join(F.broadcast(cut)).groupBy(source).agg(F.count_if(F.col(label) == 1).alias("positives"), ratio(F.count_if(flag & (F.col(label) == 1)), F.count_if(F.col(label) == 1)).alias("recall"))


def operating_point(df: DataFrame, score: str, label: str, threshold: float, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    part = lambda y, flagged: F.sum(F.when((F.col(label) == y) & flagged, w).otherwise(0.0))
    hit = F.col(score) >= threshold
    return df.groupBy(*by).agg(ratio(part(1, hit), part(1, F.lit(True))).alias("recall"), ratio(part(0, hit), part(0, F.lit(True))).alias("fpr"))


def design_effect(df: DataFrame, outcome: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Cluster variance of a rate over its binomial variance; null for fewer than two
    groups or a rate of 0 or 1."""
    g = df.groupBy(*by, group).agg(F.sum(F.col(outcome).cast("double")).alias("y"), F.count(outcome).alias("m"))
    s = g.groupBy(*by).agg(F.count("*").alias("groups"), F.sum("y").alias("sy"), F.sum("m").alias("n"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("y") * F.col("m")).alias("sym"), F.sum(F.col("m") * F.col("m")).alias("smm"))
    p = F.col("sy") / F.col("n")
    square = F.col("syy") - 2 * p * F.col("sym") + p * p * F.col("smm")
    variance = F.col("groups") / (F.col("groups") - 1) * square / (F.col("n") * F.col("n"))
    ok = (F.col("groups") >= 2) & (p > 0) & (p < 1)
    return s.select(*by, "groups", "n", p.alias("rate"), F.when(ok, variance / (p * (1 - p) / F.col("n"))).alias("design_effect"))


def frontier(df: DataFrame, score: str, label: str, step: float = 0.002, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tau, recall, fpr, f1) on a grid of thresholds from 0 to 1.

    Scores are counted per grid cell first, so the grid meets cells, not rows.
    """
    n = round(1 / step)
    cell = F.least(F.greatest(F.floor(F.col(score) / F.lit(step) + 1e-9), F.lit(-1)), F.lit(n)).cast("int")
    cells = df.where(F.col(score).isNotNull()).groupBy(*by, cell.alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    grid = cells.select(*by).distinct().withColumn("score", F.explode(F.sequence(F.lit(0), F.lit(n)))).select(*by, "score", F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    r = ranked(cells.unionByName(grid).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), by)
    f1 = F.coalesce(ratio(2 * F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg") + F.col("all_pos")), F.lit(0.0))
    return r.where("score >= 0").select(*by, (F.col("score") * F.lit(step)).alias("tau"), ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"), ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"), f1.alias("f1"))


def fpr_at_recall(df: DataFrame, score: str, label: str, recall: float, by: Sequence[str] = ()) -> DataFrame:
    """FPR at the linear (1 - recall) quantile of the positives' scores."""
    tau = df.where(F.col(label) == 1).groupBy(*by).agg(F.percentile(F.col(score).cast("double"), F.lit(1 - recall)).alias("tau"))
    joined = df.join(F.broadcast(tau), list(by)) if by else df.join(F.broadcast(tau))
    return joined.groupBy(*by).agg(F.first("tau").alias("tau"), ratio(F.count_if((F.col(label) == 0) & (F.col(score) >= F.col("tau"))), F.count_if(F.col(label) == 0)).alias("fpr"))


def partition_ledger(df: DataFrame, partition: str, source: str, label: str, group: str) -> DataFrame:
    """Per partition, and per partition and source: benign, positive, distinct groups."""
    sets = df.groupingSets([[partition], [partition, source]], partition, source)
    return sets.agg((F.grouping(source) == 1).alias("whole"), F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("positive"), F.countDistinct(group).alias("groups"))


def largest_groups(df: DataFrame, group: str, label: str, source: str, k: int = 10) -> DataFrame:
    """The k largest groups with histograms of labels and sources; ties by group."""
    top = df.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(k)
    cells = df.join(F.broadcast(top), group).groupBy(group, "n", F.col(label).alias("y"), F.col(source).alias("s")).agg(F.count("*").alias("c"))
    by_label = cells.groupBy(group, "n", "y").agg(F.sum("c").alias("c")).groupBy(group, "n").agg(F.array_sort(F.collect_list(F.concat_ws("=", F.col("y").cast("string"), F.col("c").cast("string")))).alias("labels"))
    by_source = cells.groupBy(group, "s").agg(F.sum("c").alias("c")).groupBy(group).agg(F.array_sort(F.collect_list(F.concat_ws("=", "s", F.col("c").cast("string")))).alias("sources"))
    joined = by_label.join(by_source, group, "left")
    return joined.select(group, "n", F.concat_ws(";", "labels").alias("labels"), F.concat_ws(";", "sources").alias("sources"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Percent agreement, Cohen's kappa and Gwet's AC1 of two binary labels; null where
    chance agreement is 1."""
    pa, pb = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    po = F.avg((F.col(a) == F.col(b)).cast("double"))
    s = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), po.alias("po"), pa.alias("pa"), pb.alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    pi = (F.col("pa") + F.col("pb")) / 2
    pg = 2 * pi * (1 - pi)
    return s.select("n", F.col("po").alias("agreement"), F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"), F.when(pg < 1, (F.col("po") - pg) / (1 - pg)).alias("ac1"))


def best_of_k(df: DataFrame, attack: str, score: str, threshold: float = 0.5) -> DataFrame:
    """(attack, evades): some variant scores below the threshold."""
    return df.groupBy(attack).agg((F.min(score) < threshold).alias("evades"))


def shared_decision(df: DataFrame, decision: str, least: int = 3) -> DataFrame:
    """True if at least ``least`` decisions are +1 and none is -1; nulls do not count."""
    return df.agg(F.count_if(F.col(decision) == 1).alias("positives"), F.count_if(F.col(decision) == -1).alias("negatives"), ((F.count_if(F.col(decision) == 1) >= least) & (F.count_if(F.col(decision) == -1) == 0)).alias("shared"))


def composition(df: DataFrame, text: str, by: Sequence[str], terms: dict[str, Column]) -> DataFrame:
    """Size, quartiles of length and the share of rows with each of the terms."""
    n = F.length(text).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(n, F.lit(q)).alias(name) for q, name in ((0.25, "q1_chars"), (0.5, "median_chars"), (0.75, "q3_chars"))], *[F.avg(c.cast("double")).alias(k) for k, c in terms.items()])
