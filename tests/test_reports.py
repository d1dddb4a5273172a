"""Running sums, reports, planning and errors."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import dedup as D, graph as G, inference as I, reports as P, rewriting as R, running, sampling as S, similarity as X
from lexiloom.sources import io


def test_running_sums_over_hot_groups_and_nulls(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a"] * 6 + ["b", None]), i, rng.randrange(5) if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, k int, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = running.running(df, [F.desc("k")], {"upto": F.col("v")}, ["g"], {"all": "upto"}).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(data)
    for g in ("a", "b", None):
        run, mine = 0, sorted((r for r in got if r.g == g), key=lambda r: -r.k)
        for r in mine:
            run += r.v or 0
            assert r.upto == run
        assert {r["all"] for r in mine} == {run}
    assert running.ranked(df.limit(0), [F.col("k")]).count() == 0


def test_containment_equals_brute_force(spark):
    rng = random.Random(2)
    data, sets = [], {}
    for i in range(60):
        base = f"shared opening of many texts here and more {rng.randrange(3)} " if i % 3 else ""
        t = base + " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30)))
        data.append((i, data[-1][1] if i % 10 == 9 else t))
        w = data[-1][1].split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {data[-1][1]}
    data += [(90, None)]
    df = spark.createDataFrame(data, "id int, text string").repartition(3)
    want = {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and (m := min(len(sets[i]), len(sets[j]))) and len(sets[i] & sets[j]) >= max(min(3, m), 0.5 * m)}
    normal = F.col("text")
    assert {(r.i, r.j, r.shared) for r in X.containment_edges(X.shingle_sets(df, "id", normal)).collect()} == want
    assert {(r.i, r.j, r.shared) for r in X.containment_edges(X.shingles(df, "id", normal)).collect()} == want
    roots = {r.id: r.root for r in G.containment_components(X.shingle_sets(df, "id", normal)).collect()}
    assert all(roots[i] == roots[j] for i, j, _ in want) and set(roots) == set(sets)


def test_short_draws_and_conflicts_are_errors(spark):
    df = spark.createDataFrame([(1, "x", 0), (2, "x", 1), (3, "y", 1)], "id int, fp string, label int")
    with pytest.raises(ValueError):
        S.uniform_draw(df, "id", "s", 4)
    with pytest.raises(ValueError):
        S.cell_pool(df, "id", "fp", "id", {"x": 1.0, "y": 1.0}, 3, 1, "s")
    with pytest.raises(ValueError):
        D.dedup_prefer(df, "fp", F.lit(True), "id", "label")
    assert S.uniform_draw(df, "id", "s", 4, strict=False).count() == 3


def test_planning_numbers():
    # independent normals: the product of both tails; perfect agreement is the limit
    assert abs(I.joint_survival(0.0, 0.0, 0.0) - 0.25) < 1e-9
    assert abs(I.joint_survival(1.0, -0.5, 0.0) - 0.15865525393 * 0.69146246127) < 1e-9
    assert abs(I.joint_survival(0.0, 0.0, 0.5) - (0.25 + math.asin(0.5) / (2 * math.pi))) < 1e-8
    plan = I.roc_plan(0.05, 0.5)
    assert plan["n_negative_90"] is None or plan["n_negative_90"] > plan["n_negative_80"] > 0
    se, z, t = I.least_detectable(5, 0.0, 0.3144, 0.0525, 872)
    assert abs(z - 0.141) < 0.001 and abs(t - 0.203) < 0.001


def test_recipe_and_markdown():
    assert P.recipe_success([True, True], True, [0.1], [0.05]) and not P.recipe_success([True, True], True, [0.11], [0.05])
    assert P.recipe_success([None, True], True, [0.1], [0.1]) is None
    assert P.markdown([{"a": 1.23456, "b": None}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 1.235 | - |"


def test_audits_refuse_other_labels(spark):
    owner = spark.createDataFrame([(1, "1"), (2, " 0")], "id int, y string")
    assert sorted(tuple(r) for r in P.audit_pairs(owner, spark.createDataFrame([(2, "1 ")], "id int, y string"), "id", "y").collect()) == [(2, 0, 1)]
    for bad in ((1, "x"), (3, "1"), (1, None)):
        with pytest.raises(ValueError):
            P.audit_pairs(owner, spark.createDataFrame([bad], "id int, y string"), "id", "y")


def test_prefixes_and_label_index(spark):
    means = [sum(map(len, ps)) / len(ps) for ps in R.CELLS.values()]
    overall = sum(means) / len(means)
    assert all(len(ps) == len(set(ps)) == 24 and abs(m - overall) <= 0.15 * overall for ps, m in zip(R.CELLS.values(), means)) and len(R.SHORT) == 5
    df = spark.createDataFrame([({0: " Safe", 1: "attack"},), ({0: "safe", 1: "SAFE"},), ({},), (None,)], "m map<int, string>")
    assert [r[0] for r in df.select(R.benign_index(F.col("m"), ("safe", "benign"))).collect()] == [0, None, None, None]


def test_cache_and_flat_runs(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    known = spark.createDataFrame([("a", 0.5), ("a", 0.5)], "k string, v double")
    hit, left = io.with_cache(asked, known, ["k"])
    assert [r.id for r in hit.collect()] == [1] and sorted(r.id for r in left.collect()) == [2, 3]
    nested = spark.createDataFrame([(1, (0.5, 2))], "id int, m struct<auc: double, n: int>")
    assert io.flatten_runs(nested, "m").columns == ["id", "m_auc", "m_n"]


def test_nearest_takes_the_smallest_of_equals(spark):
    pairs = spark.createDataFrame([(1, 5, 0.9), (1, 4, 0.9), (1, 6, 0.8), (2, 4, 0.7)], "i int, j int, cosine double")
    assert sorted((r.i, r.j) for r in X.nearest(pairs).collect()) == [(1, 4), (2, 4)]
