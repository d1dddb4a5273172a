"""Near-duplicates hold their bucket rows on disk run by run."""

import random

import pytest

from lexiloom.llm import neardup
from lexiloom.llm.editdup import NearCopies
from lexiloom.llm.splitoverlap import SplitOverlap


def _stages(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none, jvm = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway
    seen = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, jvm.new_array(jvm.jvm.double, 0), none)
    return {(x := seen.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(seen.size())}


@pytest.fixture
def shuffled(spark):
    """The most rows that one stage has shuffled since; no join is a broadcast, as with large tables."""
    conf = "spark.sql.autoBroadcastJoinThreshold"
    held, before = spark.conf.get(conf), set(_stages(spark))
    spark.conf.set(conf, -1)
    yield lambda: max(n for k, n in _stages(spark).items() if k not in before)
    spark.conf.set(conf, held)


def _records(n=400):
    """Texts of 40 words; to every fourth another one in which three words are others."""
    rng = random.Random(11)
    out = []
    for i in range(n):
        t = [f"w{rng.randrange(500)}" for _ in range(40)]
        out.append((f"a{i:03}", " ".join(t), "train"))
        if i % 4 == 0:
            out.append((f"b{i:03}", " ".join(t[3:] + [f"x{rng.randrange(300)}" for _ in range(3)]), "test"))
    return out


def test_pairs_shuffle_one_run_of_bands_at_a_time(spark, shuffled):
    data = _records()
    df = spark.createDataFrame(data, "id string, text string, split string").repartition(3)
    got = {tuple(r) for r in NearCopies(df, "id", "text").pairs().collect()}
    assert shuffled() <= len(data) * neardup.BANDS / 6
    assert got == {(f"a{i:03}", f"b{i:03}") for i in range(0, 400, 4)}


def test_overlap_shuffles_one_run_of_bands_at_a_time(spark, shuffled):
    data = _records()
    df = spark.createDataFrame(data, "id string, text string, split string").repartition(3)
    got = {r.id for r in SplitOverlap(df, "id", "text", "split").ids().collect()}
    assert shuffled() <= len(data) * neardup.BANDS / 6
    assert got == {f"b{i:03}" for i in range(0, 400, 4)}


def test_chance_equals_of_bucket_hashes_lose_no_pair(spark, monkeypatch):
    # all texts in one bucket a band: every pair is a candidate, none but true ones are left
    whole = neardup.Signer.sign

    def one_bucket(self, *args):
        buckets, batches = whole(self, *args)
        buckets[:] = 0xFFFFFFFF
        return buckets, batches

    df = spark.createDataFrame(_records(40), "id string, text string, split string")
    want = {tuple(r) for r in NearCopies(df, "id", "text").pairs().collect()}
    monkeypatch.setattr(neardup.Signer, "sign", one_bucket)
    got = {tuple(r) for r in NearCopies(df, "id", "text").pairs().collect()}
    assert got == want == {(f"a{i:03}", f"b{i:03}") for i in range(0, 40, 4)}
