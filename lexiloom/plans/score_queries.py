"""Queries over score tables: metrics, bootstraps, intervals, tests.

``events`` is the plain score table (score value, positive where the type is error,
group user).  For several models a crossed design is built from hashes: every arm
and model scores every event.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import inference as I, metrics as M, reports as P
from .registry import docs, lab, query, table
from .text_queries import H, U

R = lambda c, n=9: F.round(c, n)


def _round(df, *columns, n=9):
    return df.withColumns({c: F.round(c, n) for c in columns})


def scores(s, d):
    return table(s, d, "events").select("event_id", "user_id", F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"), "event_type")


EV = "(SELECT event_id, user_id, value AS score, (event_type = 'error')::INT AS label, event_type FROM events)"


def lines(s, d):
    return table(s, d, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_suppkey").alias("grp"), "l_linestatus", "l_linenumber")


LI = "(SELECT l_quantity AS score, (l_returnflag = 'R')::INT AS label, l_suppkey AS grp, l_linestatus, l_linenumber FROM lineitem)"
_CONF = "count(*) FILTER (f AND label = 1) AS tp, count(*) FILTER (f AND label = 0) AS fp, count(*) FILTER (NOT f AND label = 1) AS fn, count(*) FILTER (NOT f AND label = 0) AS tn"
_RATES = "tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9)::DOUBLE AS f1, round(fp / nullif(fp + tn, 0), 9)::DOUBLE AS fpr"

query("confusion_metrics", lambda s, d: _round(M.confusion_metrics(lines(s, d), "score", "label", 30.0, ["l_linestatus"]), "precision", "recall", "f1", "fpr"),
      f"SELECT l_linestatus, {_RATES} FROM (SELECT l_linestatus, {_CONF} FROM (SELECT *, score >= 30 AS f FROM {LI}) GROUP BY 1)")


def wilson(s, d):
    g = lines(s, d).groupBy("grp").agg(F.sum("label").alias("k"), F.count("*").alias("n"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return g.select("grp", "k", "n", R(lo).alias("low"), R(hi).alias("high"))


_Z = "1.959963984540054"
query("wilson", wilson,
      f"SELECT grp, k, n, round(greatest(0, c - h), 9)::DOUBLE AS low, round(least(1, c + h), 9)::DOUBLE AS high FROM (SELECT *, (p + z2 / (2 * n)) / (1 + z2 / n) AS c, {_Z} * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) / (1 + z2 / n) AS h FROM (SELECT grp, sum(label)::BIGINT AS k, count(*) AS n, sum(label)::DOUBLE / count(*) AS p, ({_Z})::DOUBLE * {_Z} AS z2 FROM {LI} GROUP BY grp))")
query("slice_metrics_grouping_sets", lambda s, d: _round(M.slice_metrics(scores(s, d).withColumn("fam", F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("f"), F.col("user_id") % 3))).withColumn("src", F.col("event_type")), "score", "label", 50.0, "src", "fam"), "precision", "recall", "f1", "fpr"),
      f"SELECT slice, value, n, {_RATES} FROM (SELECT CASE g WHEN 3 THEN 'all' WHEN 1 THEN 'source' ELSE 'family' END AS slice, CASE g WHEN 3 THEN '' ELSE coalesce(src, fam) END AS value, * FROM (SELECT src, fam, grouping(src, fam) AS g, count(*) AS n, {_CONF} FROM (SELECT *, score >= 50 AS f, event_type AS src, coalesce(CASE WHEN user_id % 3 > 0 THEN 'f' || (user_id % 3) END, 'unknown') AS fam FROM {EV}) GROUP BY GROUPING SETS ((), (src), (fam))))")

_RANKED = "SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS cp, sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY {by}) AS ap, sum(neg) OVER (PARTITION BY {by}) AS an FROM (SELECT {by}, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {src} WHERE score IS NOT NULL GROUP BY ALL)"


def ranked(src: str, by: str) -> str:
    return "(" + _RANKED.format(by=by, src=src) + ")"


query("auc", lambda s, d: _round(M.roc_auc(lines(s, d), "score", "label", ["l_linestatus"]), "auc"),
      f"SELECT l_linestatus, round(sum(pos * (an - cn + neg / 2)) / nullif(any_value(ap) * any_value(an), 0), 9) AS auc FROM {ranked(LI, 'l_linestatus')} GROUP BY 1")
query("auc_weighted", lambda s, d: _round(M.roc_auc(lines(s, d).withColumn("w", F.col("l_linenumber") % 4), "score", "label", ["l_linestatus"], "w"), "auc"),
      f"WITH b AS (SELECT l_linestatus, score, sum(label * (l_linenumber % 4))::DOUBLE AS pos, sum((1 - label) * (l_linenumber % 4))::DOUBLE AS neg FROM {LI} GROUP BY ALL), r AS (SELECT *, sum(neg) OVER (PARTITION BY l_linestatus ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY l_linestatus) AS ap, sum(neg) OVER (PARTITION BY l_linestatus) AS an FROM b) SELECT l_linestatus, round(sum(pos * (an - cn + neg / 2)) / nullif(any_value(ap) * any_value(an), 0), 9) AS auc FROM r GROUP BY 1")
query("average_precision", lambda s, d: _round(M.average_precision(scores(s, d).withColumn("one", F.lit(1)), "score", "label", ["one"]), "average_precision"),
      f"SELECT one, round(CASE WHEN any_value(an) > 0 THEN sum(pos * cp / (cp + cn)) / any_value(ap) END, 9) AS average_precision FROM {ranked('(SELECT *, 1 AS one FROM ' + EV + ')', 'one')} GROUP BY one")
query("threshold_under_budget", lambda s, d: _round(M.select_threshold(lines(s, d), "score", "label", 0.1, ["l_linenumber"]), "recall", "fpr").withColumn("fpr", F.abs("fpr")),
      f"WITH r AS {ranked(LI, 'l_linenumber')}, c AS (SELECT l_linenumber, score AS threshold, false AS strict, coalesce(cp / nullif(ap, 0), 0) AS recall, coalesce(cn / nullif(an, 0), 0) AS fpr FROM r UNION ALL SELECT l_linenumber, max(score), true, 0, 0 FROM r GROUP BY 1) SELECT l_linenumber, threshold, strict, round(recall, 9) AS recall, round(fpr, 9) AS fpr FROM c WHERE fpr <= 0.1 QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY recall DESC, fpr, threshold DESC, strict DESC) = 1")
query("benign_threshold", lambda s, d: M.benign_threshold(scores(s, d), "score", "label", 0.01, ["event_type"]),
      f"SELECT event_type, coalesce(max(CASE WHEN cn > floor(0.01 * an + 1e-12) THEN score END), 0) AS threshold, max(CASE WHEN cn > floor(0.01 * an + 1e-12) THEN score END) IS NOT NULL AS strict, any_value(an)::BIGINT AS n FROM {ranked('(SELECT * FROM ' + EV + ' WHERE label = 0)', 'event_type')} GROUP BY 1")
query("recall_at_fpr", lambda s, d: _round(M.recall_at_fpr(lines(s, d), "score", "label", 0.05, ["l_linenumber"]), "recall"),
      f"SELECT l_linenumber, round(max(CASE WHEN an > 0 AND ap > 0 THEN CASE WHEN cn / an <= 0.05 + 1e-12 THEN cp / ap ELSE 0 END END), 9) AS recall FROM {ranked(LI, 'l_linenumber')} GROUP BY 1")
query("recall_by_source_shared_cutoff", lambda s, d: _round(M.recall_by_source(lines(s, d), "score", "label", "l_linenumber", 0.05), "recall"),
      f"WITH r AS {ranked('(SELECT *, 1 AS one FROM ' + LI + ' WHERE label = 0)', 'one')}, t AS (SELECT max(CASE WHEN cn > floor(0.05 * an + 1e-12) THEN score END) AS t FROM r) SELECT l_linenumber, count(*) FILTER (label = 1) AS positives, round(count(*) FILTER (label = 1 AND CASE WHEN t IS NULL THEN score >= 0 ELSE score > t END) / nullif(count(*) FILTER (label = 1), 0), 9)::DOUBLE AS recall FROM {LI}, t GROUP BY 1")
query("operating_point", lambda s, d: _round(M.operating_point(lines(s, d), "score", "label", 40.0, "l_linenumber", ["l_linestatus"]), "recall", "fpr"),
      f"SELECT l_linestatus, round(sum(l_linenumber) FILTER (label = 1 AND score >= 40)::DOUBLE / sum(l_linenumber) FILTER (label = 1), 9) AS recall, round(sum(l_linenumber) FILTER (label = 0 AND score >= 40)::DOUBLE / sum(l_linenumber) FILTER (label = 0), 9) AS fpr FROM {LI} GROUP BY 1")
query("design_effect", lambda s, d: _round(M.design_effect(lines(s, d), "label", "grp", ["l_linestatus"]), "rate", "design_effect", n=8),
      f"WITH g AS (SELECT l_linestatus, grp, sum(label)::DOUBLE AS y, count(*) AS m FROM {LI} GROUP BY ALL), p AS (SELECT l_linestatus, count(*) AS g, sum(m)::BIGINT AS n, sum(y) / sum(m) AS p FROM g GROUP BY 1) SELECT l_linestatus, any_value(p.g) AS groups, any_value(n) AS n, round(any_value(p), 8) AS rate, round(CASE WHEN any_value(p.g) >= 2 AND any_value(p) > 0 AND any_value(p) < 1 THEN any_value(p.g) / (any_value(p.g) - 1.0) * sum((y - p * m) * (y - p * m)) / (any_value(n)::DOUBLE * any_value(n)) / (any_value(p) * (1 - any_value(p)) / any_value(n)) END, 8) AS design_effect FROM g JOIN p USING (l_linestatus) GROUP BY 1")


def frontier(s, d):
    f = M.frontier(lines(s, d).withColumn("score", F.col("score") / 50), "score", "label", 0.02, ["l_linestatus"])
    return _round(f, "tau", "recall", "fpr", "f1")


query("frontier_sweep", frontier,
      f"WITH t AS (SELECT l_linestatus, label, least(floor(score / 50 / 0.02 + 1e-9), 50) AS c FROM {LI}), g AS (SELECT unnest(range(51)) AS k) SELECT l_linestatus, round(k * 0.02::DOUBLE, 9) AS tau, round(count(*) FILTER (label = 1 AND c >= k) / count(*) FILTER (label = 1), 9)::DOUBLE AS recall, round(count(*) FILTER (label = 0 AND c >= k) / count(*) FILTER (label = 0), 9)::DOUBLE AS fpr, round(coalesce(2 * count(*) FILTER (label = 1 AND c >= k) / nullif(count(*) FILTER (c >= k) + count(*) FILTER (label = 1), 0), 0), 9)::DOUBLE AS f1 FROM t, g GROUP BY l_linestatus, k")
query("fpr_at_recall", lambda s, d: _round(M.fpr_at_recall(lines(s, d), "score", "label", 0.95, ["l_linestatus"]), "tau", "fpr"),
      f"WITH t AS (SELECT l_linestatus, quantile_cont(score, 0.05) AS tau FROM {LI} WHERE label = 1 GROUP BY 1) SELECT l_linestatus, round(any_value(tau), 9) AS tau, round(count(*) FILTER (label = 0 AND score >= tau) / count(*) FILTER (label = 0), 9)::DOUBLE AS fpr FROM {LI} JOIN t USING (l_linestatus) GROUP BY 1")
query("kappa_ac1", lambda s, d: _round(M.agreement(scores(s, d).select((F.col("score") > 50).cast("int").alias("a"), "label"), "a", "label"), "agreement", "kappa", "ac1"),
      f"SELECT n, round(po, 9) AS agreement, round((po - pe) / (1 - pe), 9) AS kappa, round((po - pg) / (1 - pg), 9) AS ac1 FROM (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe, 2 * ((pa + pb) / 2) * (1 - (pa + pb) / 2) AS pg FROM (SELECT count(*) AS n, avg((a = label)::INT::DOUBLE) AS po, avg(a::DOUBLE) AS pa, avg(label::DOUBLE) AS pb FROM (SELECT (score > 50)::INT AS a, label FROM {EV} WHERE score IS NOT NULL)))")


def evasion(s, d):
    e = docs(s, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).withColumn("score", rng.uniform("evade", "doc_id", "k"))
    caught = e.where("k = 0").select("doc_id", (F.col("score") >= 0.5).alias("caught"))
    return M.best_of_k(e, "doc_id", "score").join(caught, "doc_id").agg(F.count("*").alias("n"), R(F.avg(F.col("evades").cast("double"))).alias("evaded"), R(F.avg(F.when(F.col("caught"), F.col("evades").cast("double")))).alias("evaded_if_caught"))


query("best_of_k_evasion", evasion,
      f"SELECT count(*) AS n, round(avg((m < 0.5)::INT::DOUBLE), 9) AS evaded, round(avg((m < 0.5)::INT::DOUBLE) FILTER (c), 9) AS evaded_if_caught FROM (SELECT doc_id, min(s) AS m, max(s) FILTER (k = 0) >= 0.5 AS c FROM (SELECT doc_id, k, {U(chr(39) + 'evade' + chr(39), 'doc_id', 'k')} AS s FROM documents, range(10) r(k)) GROUP BY 1)")
query("shared_decision", lambda s, d: M.shared_decision(scores(s, d).groupBy("event_type").agg(F.when(F.avg("score") > 50, 1).when(F.avg("score") < 40, -1).otherwise(0).alias("decision")), "decision"),
      f"SELECT count(*) FILTER (x = 1) AS positives, count(*) FILTER (x = -1) AS negatives, count(*) FILTER (x = 1) >= 3 AND count(*) FILTER (x = -1) = 0 AS shared FROM (SELECT event_type, CASE WHEN avg(score) > 50 THEN 1 WHEN avg(score) < 40 THEN -1 ELSE 0 END AS x FROM {EV} GROUP BY 1)")

# ---- the crossed design: arms x models x events ----

ARMS = {"a0": 0.42, "a1": 0.31, "a2": 0.27}
MODELS, REPS = 5, 60


def store(s, d):
    """(arm, model, event_id, grp, stratum, prefix, flag): every arm and model on every event."""
    e = table(s, d, "events").select("event_id", F.col("user_id").alias("grp"))
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(p).alias("p")) for a, p in ARMS.items()])
    x = e.select("*", F.explode(arms).alias("x")).select("event_id", "grp", "x.arm", "x.p", F.explode(F.sequence(F.lit(0), F.lit(MODELS - 1))).alias("model"))
    flag = (rng.uniform("store", "arm", "model", "event_id") < F.col("p") + (F.col("grp") % 7) * 0.02).cast("int")
    return x.select("arm", "model", "event_id", F.col("grp").alias("group"), (F.col("event_id") % 2 + 1).cast("int").alias("stratum"), rng.bucket(24, "prefix", "arm", "event_id").alias("prefix"), flag.alias("flag"))


STORE = f"""store AS (SELECT arm, model, event_id, user_id AS grp, (event_id % 2 + 1)::INT AS stratum, {H("'prefix'", 'arm', 'event_id')} % 24 AS prefix,
({U("'store'", 'arm', 'model', 'event_id')} < p + (user_id % 7) * 0.02)::INT AS flag FROM events, (VALUES {", ".join(f"('{a}', {p}::DOUBLE)" for a, p in ARMS.items())}) a(arm, p), range({MODELS}) m(model))"""


def cells(s, d, *more):
    return store(s, d).groupBy("arm", "model", "group", *more).agg(F.sum("flag").alias("num"), F.count("*").alias("den"))


def _weights(name: str) -> str:
    return f"""g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS g FROM (SELECT DISTINCT grp FROM store)), n AS (SELECT count(*) AS n FROM g),
w AS (SELECT rep, grp, w FROM (SELECT rep, {H(f"'{name}'", 'rep', 'slot')} % n AS g, count(*) AS w FROM range({REPS}) r(rep), (SELECT g AS slot FROM g), n GROUP BY ALL) JOIN g USING (g))"""


def _draws(name: str, shared: bool) -> str:
    arm = "'all'" if shared else "arm"
    return f"dr AS (SELECT rep, arm, {H(f"'{name}:models'", arm, 'rep', 'slot')} % {MODELS} AS model, count(*) AS times FROM range({REPS}) r(rep), (SELECT DISTINCT arm FROM store), range({MODELS}) q(slot) GROUP BY ALL)"


def _means(name: str, shared: bool, arms: str) -> str:
    return f"""WITH {STORE.replace('range(', 'range(')}, {_weights(name)}, {_draws(name, shared)},
r AS (SELECT rep, arm, model, sum(w * flag)::DOUBLE / greatest(sum(w), 1e-12) AS rate FROM store JOIN w USING (grp) WHERE arm IN ({arms}) GROUP BY ALL),
m AS (SELECT rep, arm, sum(rate * times) / sum(times) AS mean FROM r JOIN dr USING (rep, arm, model) GROUP BY ALL)"""


def _pick(a: str) -> str:
    return f"max(mean) FILTER (arm = '{a}')"


query("bootstrap_weights", lambda s, d: I.cluster_weights(table(s, d, "events").select(F.col("user_id").alias("group")), "group", REPS, "bw"),
      f"WITH store AS (SELECT user_id AS grp FROM events), {_weights('bw')} SELECT rep, grp AS \"group\", w FROM w")
query("joint_bootstrap_diff", lambda s, d: _round(I.bootstrap_diff(cells(s, d), "a0", "a1", REPS, "joint", True), "diff"),
      f"{_means('joint', True, chr(39) + 'a0' + chr(39) + ',' + chr(39) + 'a1' + chr(39))} SELECT rep, round({_pick('a0')} - {_pick('a1')}, 9) AS diff FROM m GROUP BY rep")
query("unpaired_bootstrap_diff", lambda s, d: _round(I.bootstrap_diff(cells(s, d), "a0", "a2", REPS, "unp", False), "diff"),
      f"{_means('unp', False, chr(39) + 'a0' + chr(39) + ',' + chr(39) + 'a2' + chr(39))} SELECT rep, round({_pick('a0')} - {_pick('a2')}, 9) AS diff FROM m GROUP BY rep")


def within(s, d):
    """Every unit scored twice by one model: the difference is the value."""
    p = store(s, d).groupBy("model", "group", "event_id").agg((F.max(F.when(F.col("arm") == "a0", F.col("flag"))) - F.max(F.when(F.col("arm") == "a1", F.col("flag")))).alias("v"))
    c = p.groupBy(F.lit("d").alias("arm"), "model", "group").agg(F.sum("v").alias("num"), F.count("*").alias("den"))
    w = I.cluster_weights(c, "group", REPS, "within")
    return _round(I.arm_means(c, w, I.model_draws(c, "arm", "model", REPS, "within", True)).select("rep", F.col("mean").alias("diff")), "diff")


query("paired_within_model", within,
      f"WITH {STORE}, {_weights('within')}, dr AS (SELECT rep, {H(chr(39) + 'within:models' + chr(39), chr(39) + 'all' + chr(39), 'rep', 'slot')} % {MODELS} AS model, count(*) AS times FROM range({REPS}) r(rep), range({MODELS}) q(slot) GROUP BY ALL), r AS (SELECT rep, model, sum(w * v)::DOUBLE / sum(w) AS rate FROM (SELECT model, grp, event_id, max(flag) FILTER (arm = 'a0') - max(flag) FILTER (arm = 'a1') AS v FROM store GROUP BY ALL) JOIN w USING (grp) GROUP BY ALL) SELECT rep, round(sum(rate * times) / sum(times), 9) AS diff FROM r JOIN dr USING (rep, model) GROUP BY rep")
query("twoway_cell_diff", lambda s, d: _round(I.twoway_diff(cells(s, d, "prefix").where("arm in ('a0', 'a1')"), "a0", "a1", REPS, "two"), "diff"),
      f"WITH {STORE}, {_weights('two')}, v AS (SELECT rep, arm, {H(chr(39) + 'two:prefix' + chr(39), 'arm', 'rep', 'slot')} % n AS prefix, count(*) AS v FROM range({REPS}) r(rep), (SELECT arm, max(prefix) + 1 AS n FROM store WHERE arm IN ('a0', 'a1') GROUP BY 1), range(24) q(slot) WHERE slot < n GROUP BY ALL), dr AS (SELECT rep, {H(chr(39) + 'two:models' + chr(39), chr(39) + 'all' + chr(39), 'rep', 'slot')} % {MODELS} AS model, count(*) AS times FROM range({REPS}) r(rep), range({MODELS}) q(slot) GROUP BY ALL), t AS (SELECT rep, arm, model, sum(w * v * flag)::DOUBLE / greatest(sum(w * v), 1e-12) AS rate FROM store JOIN w USING (grp) JOIN v USING (rep, arm, prefix) GROUP BY ALL), gap AS (SELECT rep, model, coalesce(max(rate) FILTER (arm = 'a0'), 0) - coalesce(max(rate) FILTER (arm = 'a1'), 0) AS gap FROM t GROUP BY ALL) SELECT rep, round(sum(gap * times) / sum(times), 9) AS diff FROM gap JOIN dr USING (rep, model) GROUP BY rep")
query("interaction_diff", lambda s, d: _round(I.bootstrap_interaction(cells(s, d, "stratum").where("arm in ('a0', 'a2')"), "a0", "a2", REPS, "inter"), "diff"),
      f"WITH {STORE}, {_weights('inter')}, {_draws('inter', False)}, r AS (SELECT rep, arm, model, stratum, sum(w * flag)::DOUBLE / greatest(sum(w), 1e-12) AS rate FROM store JOIN w USING (grp) WHERE arm IN ('a0', 'a2') GROUP BY ALL), gap AS (SELECT rep, arm, model, coalesce(max(rate) FILTER (stratum = 1), 0) - coalesce(max(rate) FILTER (stratum = 2), 0) AS gap FROM r GROUP BY ALL), m AS (SELECT rep, arm, sum(gap * times) / sum(times) AS mean FROM gap JOIN dr USING (rep, arm, model) GROUP BY ALL) SELECT rep, round({_pick('a0')} - {_pick('a2')}, 9) AS diff FROM m GROUP BY rep")
query("share_t1_t3", lambda s, d: _round(I.bootstrap_share(cells(s, d), "a0", "a2", "a1", REPS, "share"), "t1", "t3", "share", n=7),
      f"{_means('share', False, chr(39) + chr(39).join(['a0', ',', 'a1', ',', 'a2']) + chr(39))}, x AS (SELECT rep, {_pick('a0')} AS b, {_pick('a2')} AS r, {_pick('a1')} AS p FROM m GROUP BY rep) SELECT rep, round(p - r, 7) AS t1, round(r - b, 7) AS t3, round((p - r) / nullif(-(r - b), 0), 7) AS share FROM x")


def conditional(s, d):
    """Rate of events (flag of a1) among rows whose condition (flag of a0) holds."""
    p = store(s, d).groupBy("model", "group", "event_id").agg(F.max(F.when(F.col("arm") == "a0", F.col("flag"))).alias("c"), F.max(F.when(F.col("arm") == "a1", F.col("flag"))).alias("e"))
    c = p.groupBy(F.lit("c").alias("arm"), "model", "group").agg(F.sum(F.col("e") * F.col("c")).alias("num"), F.sum("c").alias("den"))
    w = I.cluster_weights(c, "group", REPS, "cond")
    return _round(I.arm_means(c, w, I.model_draws(c, "arm", "model", REPS, "cond", True)).select("rep", F.col("mean").alias("rate")), "rate")


query("conditional_rate", conditional,
      f"WITH {STORE}, {_weights('cond')}, dr AS (SELECT rep, {H(chr(39) + 'cond:models' + chr(39), chr(39) + 'all' + chr(39), 'rep', 'slot')} % {MODELS} AS model, count(*) AS times FROM range({REPS}) r(rep), range({MODELS}) q(slot) GROUP BY ALL), r AS (SELECT rep, model, sum(w * c * e)::DOUBLE / greatest(sum(w * c), 1e-12) AS rate FROM (SELECT model, grp, event_id, max(flag) FILTER (arm = 'a0') AS c, max(flag) FILTER (arm = 'a1') AS e FROM store GROUP BY ALL) JOIN w USING (grp) GROUP BY ALL) SELECT rep, round(sum(rate * times) / sum(times), 9) AS rate FROM r JOIN dr USING (rep, model) GROUP BY rep")
query("percentile_ci", lambda s, d: _round(I.percentile_ci(scores(s, d), "score", 0.95, ["event_type"]), "low", "high"),
      f"SELECT event_type, round(quantile_cont(score, 0.025), 9) AS low, round(quantile_cont(score, 0.975), 9) AS high FROM {EV} GROUP BY 1")
query("boot_p", lambda s, d: _round(I.boot_p(scores(s, d).withColumn("v", F.col("score") - 50), "v", 0.0, 0.02, ["event_type"]), "p_two_sided", "p_noninferior"),
      f"SELECT event_type, round(least(1, 2 * least(avg((score - 50 <= 0)::INT::DOUBLE), avg((score - 50 >= 0)::INT::DOUBLE))), 9)::DOUBLE AS p_two_sided, round(avg((score - 50 <= -0.02)::INT::DOUBLE), 9) AS p_noninferior FROM {EV} GROUP BY 1")


def pvalues(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("test"), F.pow(rng.uniform("p", "n_name"), F.lit(4)).alias("p"))


query("holm", lambda s, d: _round(I.holm(pvalues(s, d), "test", "p"), "p", "used", n=12),
      f"WITH t AS (SELECT n_name AS test, pow({U(chr(39) + 'p' + chr(39), 'n_name')}, 4) AS p FROM nation), r AS (SELECT *, 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) AS used FROM t) SELECT test, round(p, 12) AS p, round(used, 12)::DOUBLE AS used, min((p <= used)::INT) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM r")


def per_group(s, d):
    return lines(s, d).groupBy("grp", "l_linestatus").agg(F.avg("score").alias("v"))


# quantiles are literals for the numbers of suppliers of the test tables
_T = "CASE n " + " ".join(f"WHEN {n} THEN {I.t_quantile(0.975, n - 1)!r}::DOUBLE" for n in (10, 100, 1000)) + " END"
_GROUPS = f"(SELECT grp, l_linestatus, avg(score) AS v FROM {LI} GROUP BY ALL)"
query("t_interval", lambda s, d: _round(I.t_interval(per_group(s, d).where("l_linestatus = 'O'"), "v"), "mean", "low", "high", n=8),
      f"SELECT n, round(m, 8) AS mean, round(m - {_T} * sd / sqrt(n), 8) AS low, round(m + {_T} * sd / sqrt(n), 8) AS high FROM (SELECT count(v) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM {_GROUPS} WHERE l_linestatus = 'O')")
# Welch's degrees of freedom are no integer: the quantile by its expansion around the normal one
_Q = "z + (z^3 + z) / (4 * f) + (5 * z^5 + 16 * z^3 + 3 * z) / (96 * f^2) + (3 * z^7 + 19 * z^5 + 17 * z^3 - 15 * z) / (384 * f^3) + (79 * z^9 + 776 * z^7 + 1482 * z^5 - 1920 * z^3 - 945 * z) / (92160 * f^4)"
query("welch", lambda s, d: _round(I.welch(per_group(s, d), "l_linestatus", "v", "O", "F"), "diff", "low", "high", "df", n=7),
      f"WITH a AS (SELECT avg(v) AS m, var_samp(v) / count(v) AS e, count(v) AS n FROM {_GROUPS} WHERE l_linestatus = 'O'), b AS (SELECT avg(v) AS m, var_samp(v) / count(v) AS e, count(v) AS n FROM {_GROUPS} WHERE l_linestatus = 'F'), x AS (SELECT a.m - b.m AS d, sqrt(a.e + b.e) AS se, (a.e + b.e)^2 / (a.e^2 / (a.n - 1) + b.e^2 / (b.n - 1)) AS f, {_Z}::DOUBLE AS z FROM a, b), y AS (SELECT d, f, ({_Q}) * se AS h FROM x) SELECT round(d, 7) AS diff, round(d - h, 7) AS low, round(d + h, 7) AS high, round(f, 7) AS df FROM y")
query("nadeau_bengio", lambda s, d: _round(I.nadeau_bengio(per_group(s, d).where("l_linestatus = 'F'"), "v", 700, 300), "mean", "low", "high", n=8),
      f"SELECT round(m, 8) AS mean, round(m - {_T} * sqrt((1 / n + 300 / 700) * va), 8) AS low, round(m + {_T} * sqrt((1 / n + 300 / 700) * va), 8) AS high FROM (SELECT count(v) AS n, avg(v) AS m, var_samp(v) AS va FROM {_GROUPS} WHERE l_linestatus = 'F')")
query("weighted_rate", lambda s, d: _round(P.rate(lines(s, d), "label", ["l_linestatus"], "l_linenumber"), "rate"),
      f"SELECT l_linestatus, round(sum(label * l_linenumber)::DOUBLE / sum(l_linenumber), 9) AS rate FROM {LI} GROUP BY 1")
query("rate_interval", lambda s, d: _round(P.rate_interval(cells(s, d), "a1", REPS, "rate"), "estimate", "low", "high"),
      f"{_means('rate', False, chr(39) + 'a1' + chr(39))}, p AS (SELECT count(*) AS n, avg(flag) AS r FROM store WHERE arm = 'a1' GROUP BY model) SELECT (SELECT max(n) FROM p)::BIGINT AS n_rows, round((SELECT avg(r) FROM p), 9) AS estimate, round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.975), 9) AS high FROM m")
_T5 = repr(I.t_quantile(0.975, MODELS - 1))
query("contrast", lambda s, d: _round(P.contrast(cells(s, d), "a0", "a1", REPS, "contrast"), "estimate", "boot_low", "boot_high", "t_low", "t_high"),
      f"{_means('contrast', True, chr(39) + 'a0' + chr(39) + ',' + chr(39) + 'a1' + chr(39))}, x AS (SELECT rep, {_pick('a0')} - {_pick('a1')} AS diff FROM m GROUP BY rep), q AS (SELECT model, avg(flag) FILTER (arm = 'a0') - avg(flag) FILTER (arm = 'a1') AS d FROM store GROUP BY model), t AS (SELECT avg(d) AS e, {_T5}::DOUBLE * stddev_samp(d) / sqrt(count(*)) AS h FROM q) SELECT round(any_value(e), 9) AS estimate, round(quantile_cont(diff, 0.025), 9) AS boot_low, round(quantile_cont(diff, 0.975), 9) AS boot_high, round(any_value(e - h), 9) AS t_low, round(any_value(e + h), 9) AS t_high FROM x, t")


def report(s, d):
    """Metrics of two arms on two sets of events, models scoring all of them."""
    e = table(s, d, "events").select("event_id", F.col("user_id").alias("group"), (F.col("event_type") == "error").cast("int").alias("label"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("set"))
    arms = F.explode(F.array(F.lit("a0"), F.lit("a1"))).alias("arm")
    x = e.select("*", arms).withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("budget", F.lit(25))
    score = F.round(rng.uniform("report", "arm", "model", "event_id") * 50, 0) / 50 + F.col("label") * 0.1
    x = x.withColumns({"score": F.round(score, 6), "threshold": F.lit(0.9), "row_id": F.col("event_id")})
    return _round(P.metric_report(x, 20, "report", 0.05), "estimate", "low", "high", n=7)


_W20 = f"g AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS g FROM (SELECT DISTINCT grp FROM st)), n AS (SELECT count(*) AS n FROM g), w AS (SELECT rep, grp, w FROM (SELECT rep, {H(chr(39) + 'report' + chr(39), 'rep', 'slot')} % n AS g, count(*) AS w FROM range(20) r(rep), (SELECT g AS slot FROM g), n GROUP BY ALL) JOIN g USING (g) UNION ALL SELECT -1, grp, 1 FROM g)"
query("metric_report", report, f"""WITH st AS (SELECT event_id, user_id AS grp, (event_type = 'error')::INT AS label, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS st, arm, model, round(round({U(chr(39) + 'report' + chr(39), 'arm', 'model', 'event_id')} * 50, 0) / 50 + (event_type = 'error')::INT * 0.1::DOUBLE, 6) AS score FROM events, (VALUES ('a0'), ('a1')) a(arm), range(3) m(model)), {_W20},
b AS (SELECT rep, st, arm, model, score, sum(w * label)::DOUBLE AS pos, sum(w * (1 - label))::DOUBLE AS neg FROM st JOIN w USING (grp) GROUP BY ALL),
k AS (SELECT *, sum(pos) OVER (PARTITION BY rep, st, arm, model ORDER BY score DESC) AS cp, sum(neg) OVER (PARTITION BY rep, st, arm, model ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY rep, st, arm, model) AS ap, sum(neg) OVER (PARTITION BY rep, st, arm, model) AS an FROM b),
v AS (SELECT rep, st, arm, model, sum(pos) FILTER (score > 0.9) / any_value(ap) AS operational_recall, sum(neg) FILTER (score > 0.9) / any_value(an) AS operational_fpr, max(CASE WHEN cn / an <= 0.05 + 1e-12 THEN cp / ap ELSE 0 END) AS recall_at_fpr FROM k GROUP BY ALL),
l AS (UNPIVOT v ON operational_recall, operational_fpr, recall_at_fpr INTO NAME metric VALUE value),
dr AS (SELECT rep, {H(chr(39) + 'report:models' + chr(39), chr(39) + 'all' + chr(39), 'rep', 'slot')} % 3 AS model, count(*) AS times FROM range(20) r(rep), range(3) q(slot) GROUP BY ALL),
mm AS (SELECT st, arm, metric, rep, sum(value * times) / sum(times) AS mean FROM l JOIN dr USING (rep, model) GROUP BY ALL),
ci AS (SELECT st, arm, metric, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM mm GROUP BY ALL),
es AS (SELECT st, arm, metric, avg(value) AS estimate FROM l WHERE rep = -1 GROUP BY ALL), nn AS (SELECT st, count(DISTINCT event_id) AS n_rows, count(DISTINCT event_id) FILTER (label = 1) AS n_positive, count(DISTINCT grp) AS n_groups FROM st GROUP BY 1)
SELECT st AS "set", arm, 25 AS budget, metric, round(estimate, 7) AS estimate, round(low, 7) AS low, round(high, 7) AS high, n_rows, n_positive, n_groups FROM es JOIN ci USING (st, arm, metric) JOIN nn USING (st)""")


def inflated(s, d):
    """Means of row and group splits by flag and line number."""
    t = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("detector"), F.col("l_linenumber").alias("repeat"), F.when(F.col("l_linestatus") == "O", "row").otherwise("group").alias("kind")).agg(F.avg("l_quantity").alias("value"))
    return _round(P.inflation(t, 700, 300), "row_mean", "group_mean", "inflation", "low", "high", n=8)


_TN = "CASE n " + " ".join(f"WHEN {n} THEN {I.t_quantile(0.975, n - 1)!r}::DOUBLE" for n in range(2, 8)) + " END"
query("split_inflation", inflated,
      f"WITH t AS (SELECT l_returnflag AS detector, l_linenumber AS rp, avg(l_quantity) FILTER (l_linestatus = 'O') AS r, avg(l_quantity) FILTER (l_linestatus <> 'O') AS g FROM lineitem GROUP BY ALL), s AS (SELECT detector, count(*) AS n, avg(r) AS rm, avg(g) AS gm, avg(r - g) AS i, var_samp(r - g) AS v FROM t WHERE r IS NOT NULL AND g IS NOT NULL GROUP BY 1) SELECT detector, n AS repeats, round(rm, 8) AS row_mean, round(gm, 8) AS group_mean, round(i, 8) AS inflation, round(i - {_TN} * sqrt((1 / n + 300 / 700) * v), 8) AS low, round(i + {_TN} * sqrt((1 / n + 300 / 700) * v), 8) AS high FROM s")


def audit(s, d):
    """Labels of the ledger's owner against a second annotator who differs on some."""
    owner = docs(s, d).where("label is not null").select("doc_id", "label")
    second = owner.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 11 == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"))
    return P.audit_pairs(owner, second, "doc_id", "label")


_AUDIT = "(SELECT doc_id, label AS a, CASE WHEN doc_id % 11 = 0 THEN 1 - label ELSE label END AS b FROM documents WHERE label IS NOT NULL AND doc_id % 3 > 0)"
query("audit_pairs", audit, f"SELECT * FROM {_AUDIT}")
_M = lambda s: f"SELECT {s} count(*) AS n, avg((x = y)::INT::DOUBLE) AS po, avg(x::DOUBLE) * avg(y::DOUBLE) + (1 - avg(x::DOUBLE)) * (1 - avg(y::DOUBLE)) AS pe, 2 * ((avg(x::DOUBLE) + avg(y::DOUBLE)) / 2) * (1 - (avg(x::DOUBLE) + avg(y::DOUBLE)) / 2) AS pg"
_L = lambda by: f"(SELECT {by} n, 'agreement' AS measure, po AS value FROM {{0}} UNION ALL SELECT {by} n, 'kappa', (po - pe) / (1 - pe) FROM {{0}} UNION ALL SELECT {by} n, 'ac1', (po - pg) / (1 - pg) FROM {{0}})"
query("agreement_interval", lambda s, d: _round(P.agreement_interval(audit(s, d), "a", "b", 40, "iaa"), "value", "low", "high"),
      f"WITH k AS (SELECT count(*) FILTER (a = 0 AND b = 0) AS c0, count(*) FILTER (a = 0 AND b = 1) AS c1, count(*) FILTER (a = 1 AND b = 0) AS c2, count(*) AS n FROM {_AUDIT}), z AS (SELECT rep, {H(chr(39) + 'iaa' + chr(39), 'rep', 'slot')} % n AS pos, c0, c1, c2 FROM k, range(40) r(rep), (SELECT row_number() OVER () - 1 AS slot FROM {_AUDIT})), dr AS (SELECT rep, (pos >= c0 + c1)::INT AS x, ((pos >= c0 AND pos < c0 + c1) OR pos >= c0 + c1 + c2)::INT AS y FROM z), rs AS ({_M('rep,')} FROM dr GROUP BY rep), ps AS ({_M('')} FROM (SELECT a AS x, b AS y FROM {_AUDIT})), q AS (SELECT measure, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM {_L('rep,').format('rs')} GROUP BY 1) SELECT n, measure, round(value, 9) AS value, round(low, 9) AS low, round(high, 9) AS high FROM {_L('').format('ps')} JOIN q USING (measure)")


def decided(s, d):
    """Status of the contrast of every user's scores against 50 by two intervals."""
    g = scores(s, d).groupBy("event_type").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"), F.count("*").alias("n"))
    band = lambda k: F.struct((F.col("m") - 50 - k * F.col("sd") / F.sqrt("n")).alias("low"), (F.col("m") - 50 + k * F.col("sd") / F.sqrt("n")).alias("high"))
    return g.select("event_type", I.decide(band(F.lit(0.5)), band(F.lit(2.0)), F.col("event_type") != "view").alias("x")).select("event_type", "x.*")


query("decide", decided,
      f"WITH g AS (SELECT event_type, avg(score) - 50 AS m, stddev_samp(score) / sqrt(count(*)) AS e FROM {EV} GROUP BY 1), b AS (SELECT event_type, event_type <> 'view' AS ok, (m + 0.5 * e < 0)::INT + (m + 2 * e < 0)::INT AS lo, (m - 0.5 * e > 0)::INT + (m - 2 * e > 0)::INT AS hi, m + 0.5 * e < -0.05 AND m + 2 * e < -0.05 AS five FROM g) SELECT event_type, CASE WHEN ok THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN ok THEN lo = 2 END AS reduction, CASE WHEN ok THEN hi = 2 END AS increase, CASE WHEN ok THEN lo = 1 OR hi = 1 END AS fragile, CASE WHEN ok THEN five END AS beyond_5_points FROM b")
query("pooled_vectors", lambda s, d: P.pooled_vectors(table(s, d, "embeddings").withColumn("w", F.col("vec_id") % 3), "label", "embedding", "w").select("label", F.round(F.col("vector")[0], 8).alias("first"), F.size("vector").alias("dims")),
      "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k, vec_id % 3 AS w FROM embeddings WHERE vec_id % 3 > 0), m AS (SELECT label, k, sum(x * w) / sum(w) AS m FROM e GROUP BY ALL) SELECT label, round(max(m) FILTER (k = 1) / sqrt(sum(m * m)), 8) AS first, count(*)::INT AS dims FROM m GROUP BY label")


def mined(s, d):
    """Texts that hold "ignore", a scorer without a model, and are not in the lab's test split."""
    make = lambda: (lambda texts: [float("ignore" in t.lower()) for t in texts])
    known = lab(s, d).where("split = 'test' and text is not null").select(F.lower("text").alias("key"))
    rows = lab(s, d).where("text is not null and source is not null").select("source", "text")
    return P.mine(rows, "text", "source", known, "key", F.lower("text"), make)[1]


query("mining_counts", mined,
      "WITH r AS (SELECT source, text, lower(text) NOT IN (SELECT lower(text) FROM injection_lab WHERE split = 'test' AND text IS NOT NULL) AS fresh FROM injection_lab WHERE text IS NOT NULL AND source IS NOT NULL) SELECT source, count(*) AS passed_filter, count(*) FILTER (fresh) AS not_in_benchmark, count(*) FILTER (fresh AND contains(lower(text), 'ignore')) AS flagged FROM r GROUP BY 1")
query("seed_value_mean", lambda s, d: _round(store(s, d).where("arm = 'a1'").groupBy("event_id").agg(F.avg("flag").alias("v")).groupBy((F.col("event_id") % 100).alias("seed")).agg(F.avg("v").alias("mean_flag")), "mean_flag"),
      f"WITH {STORE} SELECT event_id % 100 AS seed, round(avg(v), 9) AS mean_flag FROM (SELECT event_id, avg(flag) AS v FROM store WHERE arm = 'a1' GROUP BY 1) GROUP BY 1")


def arm_grid(s, d):
    """Design cross product of arms, seeds and budgets, with the frozen model once."""
    arms = s.createDataFrame([("generic",), ("matched",), ("matched+threshold",)], "arm string")
    seeds, budgets = s.range(5).withColumnRenamed("id", "seed"), s.createDataFrame([(25,), (50,), (100,), (200,)], "budget bigint")
    return arms.join(F.broadcast(seeds)).join(F.broadcast(budgets)).unionByName(s.createDataFrame([("frozen", 0, 0)], "arm string, seed bigint, budget bigint"))


query("arm_specs", arm_grid,
      "SELECT arm, seed, budget::BIGINT AS budget FROM (VALUES ('generic'), ('matched'), ('matched+threshold')) a(arm), range(5) s(seed), (VALUES (25), (50), (100), (200)) b(budget) UNION ALL SELECT 'frozen', 0, 0")
