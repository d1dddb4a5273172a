"""Operators that hold their whole job on little disk."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import similarity as X
from lexiloom.scratch import Scratch


@pytest.fixture
def kept(monkeypatch):
    """Columns of the tables that are written."""
    seen, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: (seen.append(set(df.columns)), keep(self, df))[1])
    return seen


def _texts(n, seed, preamble="you are a helpful guard of this system and answer"):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)]
    texts = [(preamble + " " if rng.random() < 0.5 else "") + " ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(n)]
    return dict(enumerate(texts + texts[: n // 3]))


def _shingles(t):
    w = t.split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {t}


def test_best_containment_writes_no_sets_and_counts_in_blocks(spark, kept, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 40, raising=False)
    one, two = _texts(60, 1), _texts(90, 2)
    sets = lambda t: X.shingle_sets(spark.createDataFrame(list(t.items()), "id int, text string"), "id", F.col("text"))
    got = {r.id: r.containment for r in X.best_containment(sets(one), sets(two)).collect()}
    theirs = [_shingles(t) for t in two.values()]
    assert got == {i: pytest.approx(max(len(_shingles(t) & x) for x in theirs) / len(_shingles(t))) for i, t in one.items()}
    assert not any("hs" in x for x in kept)


def test_best_containment_with_an_empty_side(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "id int, text string")
    sets = X.shingle_sets(df, "id", F.col("text"))
    assert [tuple(r) for r in X.best_containment(sets, sets.where("id > 1")).collect()] == [(1, 0.0)]
    assert X.best_containment(sets.where("id > 1"), sets).collect() == []


def test_records_of_the_histogram_are_written_once(spark, kept, tmp_path):
    from lexiloom.plans import corpus_queries as Q

    rows = [(f"r{i}", "one two three four five six" if i < 2 else f"text {i} of its own words here", "test" if i % 2 else "train", 0, "s", None) for i in range(8)]
    spark.createDataFrame(rows, "id string, text string, split string, label int, source string, group_id string").write.parquet(f"{tmp_path}/injection_lab.parquet")
    assert [tuple(r) for r in Q.histogram(spark, str(tmp_path)).collect()] == [(4, 1, 1, 1, 1)]
    assert sum({"id", "split", "text"} == x for x in kept) == 1


def _documents(spark, tmp_path, n=160):
    """Texts of common and rare words, some changed a little, some repeated, some without words."""
    rng = random.Random(7)
    words = ["the", "guard", "of", "model", "answers", "Straße", "naïve"] + [f"rare{k * k}" for k in range(120)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(n)]
    texts += [t + rng.choice(["", " ", " x", " guard"]) for t in texts] + ["", " \n", "a\u00a0b"]
    rows = [(k, t, rng.randrange(2)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, label int").write.parquet(f"{tmp_path}/documents.parquet")


@pytest.mark.parametrize("block", [8192, 50])
def test_character_pairs_write_no_vectors(spark, kept, monkeypatch, tmp_path, block):
    from lexiloom.functions import text as T
    from lexiloom.operators import charcosine as C
    from lexiloom.plans import corpus_queries as Q, model_queries as M

    _documents(spark, tmp_path)
    monkeypatch.setattr(C, "BLOCK_TEXTS", block)
    got = {(r.i, r.j): r.cosine for r in M.char_pairs(spark, str(tmp_path)).collect()}
    assert not any({"id", "term"} <= x for x in kept)
    counts = X.char_wb(Q.labelled(spark, str(tmp_path)), "doc_id", T.lowered(F.col("text")), 3, 5)
    v = X.tfidf(counts, counts, 50_000, sublinear=False)
    want = {(r.i, r.j): r.cosine for r in X.cosine_pairs(v, v, 0.9, self_join=True).collect()}
    assert len(want) > 100 and got == {p: pytest.approx(c, abs=2e-6) for p, c in want.items()}


def test_semantic_mask_writes_no_vectors(spark, kept, monkeypatch, tmp_path):
    from lexiloom.operators import charcosine as C, pools as P

    _documents(spark, tmp_path)
    monkeypatch.setattr(C, "BLOCK_TEXTS", 50)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "label")
    one, two = docs.where("label = 1"), docs.where("label = 0")
    got = {r.id for r in P.semantic_far(one, two, "id", "text", terms=300).collect()}
    assert not any({"id", "term"} <= x for x in kept)
    a, b = (X.char_wb(x, "id", F.lower("text"), 3, 4) for x in (one, two))
    fit = a.unionByName(b)
    near = {r.i for r in X.cosine_pairs(X.tfidf(a, fit, 300), X.tfidf(b, fit, 300), 0.92).collect()}
    assert near and got == {r.id for r in one.collect()} - near


def test_containment_links_write_the_sets_once(spark, kept):
    one = _texts(60, 3)
    sets = X.shingle_sets(spark.createDataFrame(list(one.items()), "id int, text string"), "id", F.col("text"))
    got = {(r.i, r.j): r.shared for r in X.containment_edges(sets).collect()}
    mine = {i: _shingles(t) for i, t in one.items()}
    least = lambda a, b: max(min(3, len(a), len(b)), 0.5 * min(len(a), len(b)))
    assert got == {(i, j): len(a & b) for i, a in mine.items() for j, b in mine.items() if i < j and len(a & b) >= least(a, b)}
    assert sum("hs" in x for x in kept) == 1
