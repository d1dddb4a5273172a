"""Reports composed of metrics and bootstraps: rates with intervals, contrasts of arms,
metrics of every set, arm and budget, split inflation, audits and mining.

``cells`` are (arm, model, group, num, den) sums, one row each, as in inference.py.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from . import inference as I, metrics as M
from .scoring import Scorer, score_with


def rate(df: DataFrame, flag: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., rate): mean of a 0/1 column, weighted if asked; null without weight."""
    w = F.when(F.col(flag).isNotNull(), F.col(weight).cast("double") if weight else F.lit(1.0))
    return df.groupBy(*by).agg(M.ratio(F.sum(w * F.col(flag)), F.sum(w)).alias("rate"))


def rate_interval(cells: DataFrame, arm: str, reps: int, name: str, level: float = 0.95) -> DataFrame:
    """(n_rows, estimate, low, high): mean over models of an arm's rate, and the percentile
    interval over drawn groups and models; nulls if the arm has no rows."""
    mine = cells.where(F.col("arm") == arm)
    boot = I.arm_means(mine, I.cluster_weights(mine, "group", reps, name), I.model_draws(mine, "arm", "model", reps, name, False))
    ci = I.percentile_ci(boot, "mean", level)
    models = mine.groupBy("model").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    point = models.agg(F.max("den").cast("bigint").alias("n_rows"), F.avg(M.ratio(F.col("num"), F.col("den"))).alias("estimate"))
    return point.join(F.broadcast(ci))  # one row each


def model_differences(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(model, difference): rate of arm a less rate of arm b for each model of both."""
    rates = cells.where(F.col("arm").isin(a, b)).groupBy("model", "arm").agg((F.sum("num") / F.sum("den")).alias("rate"))
    wide = rates.groupBy("model").agg(*[F.max(F.when(F.col("arm") == x, F.col("rate"))).alias(k) for x, k in ((a, "a"), (b, "b"))])
    return wide.select("model", (F.col("a") - F.col("b")).alias("difference")).where("difference is not null")


def contrast(cells: DataFrame, a: str, b: str, reps: int, name: str, level: float = 0.95) -> DataFrame:
    """(estimate, boot_low, boot_high, t_low, t_high): the difference of two arms, its
    interval over drawn groups and models, and Student's interval over the models."""
    boot = I.percentile_ci(I.bootstrap_diff(cells, a, b, reps, name, True), "diff", level).toDF("boot_low", "boot_high")
    t = I.t_interval(model_differences(cells, a, b), "difference", level).select(F.col("mean").alias("estimate"), F.col("low").alias("t_low"), F.col("high").alias("t_high"))
    return t.join(F.broadcast(boot)).select("estimate", "boot_low", "boot_high", "t_low", "t_high")


def noninferior(low: Column, margin: float = 0.02) -> Column:
    """A difference, higher being better, whose interval begins above -margin."""
    return low > -margin


#: Ceilings of the false positive rates of a recipe that fixes both.
EXTERNAL_MOST = CURATED_MOST = 0.10


def recipe_success(reductions: Sequence[bool | None], kept: bool | None, external_high: Sequence[float], curated_high: Sequence[float]) -> bool | None:
    """All reductions hold, recall is kept, and both rates' upper bounds are below their
    ceilings; null if a decision is open."""
    if kept is None or any(x is None for x in reductions):
        return None
    return bool(all(reductions) and kept and max(external_high) <= EXTERNAL_MOST and max(curated_high) <= CURATED_MOST)


def metric_report(scored: DataFrame, reps: int, name: str, alpha: float = 0.01, level: float = 0.95) -> DataFrame:
    """(set, arm, budget, metric, estimate, low, high, n_rows, n_positive, n_groups).

    ``scored``: (set, arm, budget, model, row_id, group, label, score, threshold), every
    model of a cell scoring every row of its set.  Metrics are the recall and the false
    positive rate at the threshold (scores above it are flagged) and the recall at a false
    positive rate of ``alpha``; sets without positives have the rate only.  Groups are
    drawn once for all arms; a replicate's value is the mean over drawn models.
    """
    cell = ["set", "arm", "budget"]
    blocks = scored.groupBy(*cell, "model", "group", "label", "score", "threshold").agg(F.count("*").alias("c"))
    weights = I.cluster_weights(scored, "group", reps, name).unionByName(scored.select("group").distinct().select(F.lit(-1).alias("rep"), "group", F.lit(1).cast("bigint").alias("w")))
    drawn = blocks.join(weights, "group").withColumn("cw", F.col("c") * F.col("w"))
    by = [*cell, "model", "rep"]
    part = lambda y, flagged: F.sum(F.when((F.col("label") == y) & flagged, F.col("cw")).otherwise(0.0))
    hit = F.col("score") > F.col("threshold")
    point = drawn.groupBy(*by).agg(M.ratio(part(1, hit), part(1, F.lit(True))).alias("operational_recall"), M.ratio(part(0, hit), part(0, F.lit(True))).alias("operational_fpr"))
    ranked = M.recall_at_fpr(drawn, "score", "label", alpha, by, "cw").withColumnRenamed("recall", "recall_at_fpr")
    names = ["operational_recall", "operational_fpr", "recall_at_fpr"]
    wide = point.join(ranked, by)
    long = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select(*by, "m.metric", "m.value")
    estimate = long.where("rep = -1").groupBy(*cell, "metric").agg(F.avg("value").alias("estimate")).where("estimate is not null")
    arms = scored.select(F.to_json(F.struct(*cell)).alias("cell"), "model").distinct()
    draws = I.model_draws(arms, "cell", "model", reps, name, True)
    mean = long.withColumn("cell", F.to_json(F.struct(*cell))).join(draws, ["rep", "cell", "model"]).groupBy(*cell, "metric", "rep").agg(M.ratio(F.sum(F.col("value") * F.col("times")), F.sum(F.when(F.col("value").isNotNull(), F.col("times")))).alias("mean"))
    ci = I.percentile_ci(mean, "mean", level, [*cell, "metric"])
    rows = scored.groupBy("set").agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct(F.when(F.col("label") == 1, F.col("row_id"))).alias("n_positive"), F.countDistinct("group").alias("n_groups"))
    return estimate.join(ci, [*cell, "metric"]).join(rows, "set")


def inflation(tasks: DataFrame, n_train: int, n_test: int, by: str = "detector", repeat: str = "repeat", kind: str = "kind", value: str = "value") -> DataFrame:
    """(by, repeats, row_mean, group_mean, inflation, low, high): how much a metric is
    higher on row splits than on group splits of the same repeat.

    ``tasks``: one row for each (by, repeat, kind in row, group).  Repeats without one of
    both do not count; NaN counts as null.  The interval corrects for overlapping splits.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    of = lambda k: F.max(F.when(F.col(kind) == k, v))
    both = tasks.groupBy(by, repeat).agg(of("row").alias("r"), of("group").alias("g"), F.count_if(F.col(kind) == "row").alias("nr"), F.count_if(F.col(kind) == "group").alias("ng")).where("nr > 0 and ng > 0")
    d = F.col("r") - F.col("g")
    s = both.groupBy(by).agg(F.count("*").alias("repeats"), F.avg("r").alias("row_mean"), F.avg("g").alias("group_mean"), F.avg(d).alias("inflation"), F.count(d).alias("n"), F.var_samp(d).alias("v"))
    # quantiles by the number of repeats, which is bounded by the design
    sizes = [r.n for r in s.where("n > 1").select("n").distinct().collect()]
    table = F.create_map(*[F.lit(x) for n in sizes for x in (n, I.t_quantile(0.975, n - 1))]) if sizes else F.create_map().cast("map<bigint, double>")
    half = F.try_element_at(table, F.col("n")) * F.sqrt((1 / F.col("n") + F.lit(n_test / n_train)) * F.col("v"))
    return s.select(by, "repeats", "row_mean", "group_mean", "inflation", (F.col("inflation") - half).alias("low"), (F.col("inflation") + half).alias("high"))


def audit_pairs(owner: DataFrame, second: DataFrame, id: str, label: str) -> DataFrame:
    """(id, a, b): labels of both annotators, joined on the audit id.  A label that is not
    0 or 1, or an id the owner has not, is an error."""
    plain = lambda side: F.trim(F.col(side).cast("string"))
    both = second.select(id, plain(label).alias("b")).join(owner.select(id, plain(label).alias("a"), F.lit(True).alias("known")), id, "left")
    for row in both.where("known is null or not (a in ('0', '1') and b in ('0', '1')) or a is null or b is null").limit(1).collect():
        raise ValueError(f"audit row {row[id]} needs a 0 or 1 from both annotators")
    return both.select(id, F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))


def agreement_interval(df: DataFrame, a: str, b: str, reps: int, name: str, level: float = 0.95) -> DataFrame:
    """Agreement, kappa and AC1 with row-bootstrap intervals.

    Rows fall into four kinds, so a replicate draws kinds by their counts; no row is
    joined with replicates.
    """
    kinds = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(f"n{x}{y}") for x in (0, 1) for y in (0, 1)])
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    slots = kinds.withColumn("n", n).where("n > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition("rep").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    at = slots.withColumn("at", rng.bucket(F.col("n"), name, "rep", "slot"))
    x = (F.col("at") >= F.col("n00") + F.col("n01")).cast("int")
    y = ((F.col("at") >= F.col("n00")) & (F.col("at") < F.col("n00") + F.col("n01")) | (F.col("at") >= F.col("n00") + F.col("n01") + F.col("n10"))).cast("int")
    drawn = at.select("rep", x.alias("x"), y.alias("y"))

    def measures(of: DataFrame, p: str, q: str, by: Sequence[str]) -> DataFrame:
        s = of.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(p) == F.col(q)).cast("double")).alias("po"), F.avg(F.col(p).cast("double")).alias("pa"), F.avg(F.col(q).cast("double")).alias("pb"))
        pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
        pi = (F.col("pa") + F.col("pb")) / 2
        chance = lambda e: F.when(e < 1, (F.col("po") - e) / (1 - e))
        return s.select(*by, "n", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in (("agreement", F.col("po")), ("kappa", chance(pe)), ("ac1", chance(2 * pi * (1 - pi))))])).alias("m")).select(*by, "n", "m.measure", "m.value")

    point = measures(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b, [])
    return point.join(I.percentile_ci(measures(drawn, "x", "y", ["rep"]), "value", level, ["measure"]), "measure", "left")


def mine(df: DataFrame, text: str, source: str, known: DataFrame, key: str, normal: Column, make: Callable[[], Scorer], threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Rows a detector flags among those that are not in a benchmark, and counts by source
    (passed_filter, not_in_benchmark, flagged).  ``known``: (key) of the benchmark."""
    rows = df.withColumn("_k", normal).withColumn("_id", F.monotonically_increasing_id())
    fresh = rows.join(known.select(F.col(key).alias("_k")).distinct(), "_k", "left_anti")
    scores = score_with(fresh, "_id", text, make, "miner").where(F.col("score") >= threshold).select(F.col("id").alias("_id"))
    flagged = fresh.join(scores, "_id", "left_semi").drop("_k", "_id")
    count = lambda x, c: x.groupBy(source).agg(F.count("*").alias(c))
    counts = count(df, "passed_filter").join(count(fresh, "not_in_benchmark"), source, "left").join(count(flagged, "flagged"), source, "left")
    return flagged, counts.fillna(0)


def pooled_vectors(chunks: DataFrame, id: str, vector: str, weight: str) -> DataFrame:
    """(id, vector): weighted mean of the vectors of a text's chunks, of length one; null
    where it has none.  Sums go by position, so a text may have any number of chunks."""
    each = chunks.where(F.col(vector).isNotNull() & (F.col(weight) > 0)).select(id, F.posexplode(vector).alias("k", "x"), F.col(weight).alias("w"))
    mean = each.groupBy(id, "k").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    whole = mean.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("norm", norm).select(id, F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).alias("vector"))


def markdown(rows: Sequence[dict], columns: Sequence[str], digits: int = 3) -> str:
    """A small table in Markdown; numbers rounded, missing values as a dash."""
    cell = lambda v: "-" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line([cell(r.get(c)) for c in columns]) for r in rows)])
