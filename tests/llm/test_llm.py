"""The llm operators against brute force, with nulls, ties, repeats, empty tables and
clashing column names."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import formatdup, neardup
from lexiloom.llm.bloom import build
from lexiloom.llm.canon import field_marks, mark_pattern, FIELD_NAMES
from lexiloom.llm.components import hash_to_min, matches
from lexiloom.llm.editdup import NearCopies
from lexiloom.llm.formatdup import LayoutCopies
from lexiloom.llm.groupsplit import GroupSplit, entity_components
from lexiloom.llm.packing import Packer, fill, hilbert, pack
from lexiloom.llm.proportions import TargetSample, seats
from lexiloom.llm.splitoverlap import SplitOverlap
from lexiloom.llm.stuffing import blocks, stuffed_pages, usual_ratio
from lexiloom.llm.tokenize import Merger, decode, encode, encode_batch, load_ranks
from lexiloom.scratch import Scratch

WORD = re.compile(r"[^\W_]+")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


# ---- 1 ----


def test_matches_and_components(spark):
    nan = float("nan")
    lines = [("a", "b", 0.9), ("b", "a", 0.86), ("b", "c", 0.85), ("c", "d", 0.84), ("e", "e", 1.0), (None, "f", 0.9), ("g", "h", nan), ("i", "j", None), ("k", "l", -0.9), ("z", "y", 1.0), ("z", "y", 1.0)]
    df = spark.createDataFrame(lines, "left_id string, right_id string, cosine double").withColumns({"v": F.lit(1), "u": F.lit(2), "id": F.lit("x"), "group_id": F.lit(0)})
    assert rows(hash_to_min(matches(df))) == [("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")]
    assert hash_to_min(matches(df.limit(0))).count() == 0


def test_components_brute_force(spark):
    rng = random.Random(1)
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(80)] + [(f"r{rng.randrange(40)}", f"r{rng.randrange(40)}") for _ in range(30)]
    edges = [e for e in edges if e[0] != e[1]]
    sets = Sets()
    for a, b in edges:
        sets.join(a, b)
    got = dict(rows(hash_to_min(spark.createDataFrame(edges, "a string, b string"))))
    assert got == {x: sets.find(x) for x in list(sets)}


# ---- 4 ----

TEXTS = ["Hello, World", "hello   world!", "HELLO_world", "hello worlds", "Straße nach Ulm", "STRASSE NACH ULM", "", None, "...", "x" * 5000, "X" * 5000,
         "instruction: a b | input: c", "input=c; instruction=A, b", '{"Input": "c", "instruction": "a b"}', "instruction: a c | input: b", "instruction a b input c", "input: c\ninstruction: a b", "context: q"]


def test_fields_are_read_in_every_notation():
    mark = mark_pattern(FIELD_NAMES)
    for t in ("instruction: a | input: b", "instruction=a; input=b", '{"instruction": "a", "input": "b"}', '{\n  "instruction": "a",\n  "input": "b"\n}', "instruction: a\ninput: b"):
        assert [m[0] for m in field_marks(t, mark)] == ["instruction", "input"]
    for t in ("see instruction: a | input: b", "instruction: only one", "my input and context", ""):
        assert field_marks(t, mark) == []


def test_layout_copies(spark):
    data = [(f"t{i:02}", t, 1, "w") for i, t in enumerate(TEXTS)] + [("t00", TEXTS[0], 1, "w"), (None, TEXTS[0], 1, "w")]
    df = spark.createDataFrame(data, "id string, body string, n int, words string")
    found = LayoutCopies(df, "id", "body")
    want = {("t00", "t01"), ("t00", "t02"), ("t04", "t05"), ("t09", "t10"), ("t11", "t12"), ("t11", "t13"), ("t11", "t15"), ("t11", "t16")}
    assert set(rows(found.copies())) == want
    copies = dict(rows(found.records()))
    assert copies["t00"] == 3 and copies["t11"] == 5 and copies["t03"] == 1 and sum(copies.values()) == len(TEXTS)
    empty = LayoutCopies(df.limit(0), "id", "body")
    assert empty.copies().count() == 0 and empty.records().count() == 0


def test_ranges_of_hashes_give_the_same_copies(spark, monkeypatch):
    data = [(f"t{i:03}", TEXTS[i % len(TEXTS)] if i % 4 else f"own {i}") for i in range(120)]
    df = spark.createDataFrame(data, "id string, text string").repartition(3)
    want = rows(LayoutCopies(df, "id", "text").copies())
    monkeypatch.setattr(formatdup, "RANGE_HASHES", 50)
    assert rows(LayoutCopies(df, "id", "text").copies()) == want and want


def test_one_text_may_hold_a_third_of_the_rows(spark):
    data = [(f"h{i:05}", "Same text here!" if i % 3 == 0 else f"own text {i}") for i in range(3000)]
    got = rows(LayoutCopies(spark.createDataFrame(data, "id string, text string").repartition(5), "id", "text").copies())
    assert got == [("h00000", f"h{i:05}") for i in range(3, 3000, 3)]


def test_filter_never_misses_a_repeat(spark):
    rng = random.Random(2)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(3000)]
    twice = rng.sample(values, 200)
    df = spark.createDataFrame([(v,) for v in values + twice] + [(None,)], "h long").repartition(6)
    seen = build(df, "h", 3200)
    assert seen.holds(np.array(twice).view(np.uint64)).all()
    once = sorted(set(values) - set(twice))
    assert seen.holds(np.array(once).view(np.uint64)).mean() < 0.05


# ---- 2 and 5 ----


def _corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    out = {}
    for i in range(n):
        t = rng.choices(vocabulary, k=rng.randrange(25, 60))
        out[f"a{i:03}"] = " ".join(t)
        if i % 3 == 0:
            u = list(t)
            for _ in range(rng.randrange(1, len(u) // 3)):
                u[rng.randrange(len(u))] = rng.choice(vocabulary)
            rng.shuffle(u)
            out[f"b{i:03}"] = " ".join(u)
        if i % 7 == 0:
            out[f"c{i:03}"] = out[f"a{i:03}"].upper() + "!"
    return out


def _near(texts):
    bag = {i: Counter(WORD.findall(t.casefold())) for i, t in texts.items()}
    seq = {i: WORD.findall(t.casefold()) for i, t in texts.items()}
    return {(a, b) for a in texts for b in texts if a < b and seq[a] != seq[b] and 4 * sum((bag[a] & bag[b]).values()) >= 3 * max(len(seq[a]), len(seq[b]))}


def test_near_duplicates_brute_force(spark):
    texts = _corpus()
    data = [(i, t, 0, 0) for i, t in texts.items()] + [("a000", texts["a000"], 0, 0), ("n1", None, 0, 0), ("n2", "", 0, 0), ("n3", "-- !", 0, 0), (None, texts["a003"], 0, 0)]
    df = spark.createDataFrame(data, "id string, text string, key int, bag int").repartition(3)
    found = NearCopies(df, "id", "text")
    want = _near(texts)
    got = set(rows(found.pairs()))
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 15
    sets = Sets()
    for a, b in got | {(a.replace("c", "a"), a) for a in texts if a[0] == "c"}:
        sets.join(a, b)
    groups = defaultdict(set)
    for i, g in rows(found.groups()):
        groups[g].add(i)
    assert {frozenset(v) for v in groups.values()} == {frozenset(i for i in texts if sets.find(i) == r) for r in {sets.find(i) for i in texts}}
    none = NearCopies(df.limit(0), "id", "text")
    assert none.pairs().count() == 0 and none.groups().count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    # equal lengths and 75 of 100 words shared: bag similarity 0.6, the least that a pair may have
    data = []
    for i in range(400):
        t = [f"w{i}x{k}" for k in range(125)]
        data += [(f"a{i:03}", " ".join(t[:100])), (f"b{i:03}", " ".join(t[25:]))]
    got = set(rows(NearCopies(spark.createDataFrame(data, "id string, text string"), "id", "text").pairs()))
    assert got <= {(f"a{i:03}", f"b{i:03}") for i in range(400)} and len(got) >= 0.92 * 400


def test_bags_are_compared_exactly():
    rng = random.Random(15)
    for _ in range(50):
        a, b = ({rng.randrange(300) << 39 | 7 for _ in range(rng.randrange(1, 60))} for _ in range(2))
        raw = [b"".join(x.to_bytes(6, "little") for x in sorted(v)) for v in (a, b)]
        assert neardup.shared_words(*raw) == len(a & b)


def test_posterior_bounds_rise_with_agreement():
    t = neardup.reachable(64)
    assert list(t) == sorted(t) and t[64] == 1 and t[20] < 0.6 < t[40]


def test_overlap_across_splits(spark):
    texts = _corpus(5, 40)
    rng = random.Random(6)
    names = ["train", " Train", "test", "TEST ", "val", "dev", "", None, "holdback"]
    data = [(i, t, rng.choice(names), f"S_{rng.randrange(2)} ") for i, t in texts.items()]
    data += [(i, t, "train", "s") for i, t, s, _ in data[:3]] + [("w", "?", "test", "s"), ("w2", "?", "train", "s"), (None, "x", "train", "s")]
    df = spark.createDataFrame(data, "id string, text string, split string, source string")
    plain = lambda s: {"val": "validation", "dev": "validation"}.get((s or "").strip().lower(), (s or "").strip().lower())
    splits = defaultdict(set)
    for i, t, s, _ in data:
        splits[i].add(plain(s))
    near = _near(texts)
    word = {i: tuple(WORD.findall(t.casefold())) for i, t in texts.items()}
    taught = {i for i in texts if "train" in splits[i]}
    asked = {i for i in texts if splits[i] & {"test", "validation"}}
    want = {i for i in asked if any(word[i] == word[j] or tuple(sorted((i, j))) in near for j in taught)}
    found = SplitOverlap(df, "id", "text", "split", ["source"])
    assert {r[0] for r in rows(found.ids())} == want and want
    report = found.report("source").collect()
    assert all(r.exact_records + r.near_records == r.overlapping_records <= r.records for r in report)
    assert {r.source for r in report} <= {"s-0", "s-1", "s"}


# ---- 3 ----


def test_seats_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        shares = {c: rng.randrange(1, 9) / 20 for c in "abcd"}
        sizes = {c: rng.randrange(0, 30) for c in "abcd"}
        floors = {c: rng.randrange(0, 4) for c in "abcd"}
        n = rng.randrange(0, 50)
        got = seats(sizes, shares, floors, n)
        first = [(0, c, k) for c in shares for k in range(min(sizes[c], floors[c]))]
        rest = [((k + 0.5) / shares[c], c, k) for c in shares for k in range(floors[c], sizes[c])]
        chosen = sorted(first, key=lambda x: x[1])[:n]
        chosen += sorted(rest)[: n - len(chosen)]
        assert sum(got.values()) == len(chosen) and all(got[c] <= sizes[c] for c in got)
        # the largest priority taken beyond the floors is no larger than any left
        left = [(got[c] + 0.5) / shares[c] for c in shares if got[c] < sizes[c] and got[c] >= floors[c]]
        taken = [(got[c] - 0.5) / shares[c] for c in shares if got[c] > floors[c]]
        assert not left or not taken or max(taken) <= min(left) + 1e-9


def test_sample_meets_targets(spark):
    data = [(f"r{i:04}", "ABBCCCCCCC"[i % 10] if i % 17 else None) for i in range(2000)] + [("r0001", "C"), (None, "A")]
    targets = spark.createDataFrame([("A", 0.5, 5), ("B", 0.3, 5), ("C", 0.1, 60), ("D", 0.1, 3), (None, 0.1, 1)], "category string, share double, min_rows long")
    df = spark.createDataFrame(data, "key string, cat string").withColumn("draw", F.lit(1))
    s = TargetSample(df, "key", "cat", targets, n=200)
    got = s.sample().collect()
    per = Counter(r.category for r in got)
    assert len(got) == 200 == len({r.key for r in got}) and per["C"] >= 60 and {r["rank"] for r in got if r.category == "C"} == set(range(1, per["C"] + 1))
    report = {r.category: r for r in s.report().collect()}
    assert not report["D"].min_met and report["D"].short_by == 20 and report["C"].min_met and report["B"].sampled == per["B"]
    again = TargetSample(df.repartition(7), "key", "cat", targets, n=200).sample().collect()
    assert {r.key for r in again} == {r.key for r in got}
    assert TargetSample(df.limit(0), "key", "cat", targets).sample().count() == 0


# ---- 6 ----


def test_chains_of_records_and_entities(spark):
    links = [(f"r{i}", f"e{i:02}") for i in range(20)] + [(f"r{i}", f"e{i + 1:02}") for i in range(20)] + [("q", "x"), ("q", None), (None, "e00"), ("p", "y")]
    got = dict(rows(entity_components(spark.createDataFrame(links, "record string, entity string"), "record", "entity", Scratch(spark))))
    assert got == {**{f"e{i:02}": "e00" for i in range(21)}, "x": "x", "y": "y"}


def test_groups_are_not_divided(spark):
    rng = random.Random(8)
    digits = [f"{i:020x}" for i in range(400)]
    data = []
    for i, h in enumerate(digits):
        n = 3000 if i == 0 else rng.choice((1, 1, 2, 3, 10))
        data.append((f"g:{h}", n, "S-train", (n, None)))
        if i % 10 == 0:
            data.append((f" G:{h.upper()} ".replace("G:", rng.choice(("G:", ""))), 1, rng.choice(("s_test ", "S-TRAIN", "T-bank")), (None, 1)))
        if i % 25 == 0:
            data.append((f"g:{h}", rng.choice((0, None)), "U-eval", None))
            data.append((f"g:{h}", 2, rng.choice(("", None, " ")), None))
    data += [("g:" + "f" * 20, 1, "T-bank", None), ("g:" + "f" * 20, 1, "t_bank_discarded_positive", None), (None, 1, "S-cal", None)]
    df = spark.createDataFrame(data, "`group` string, `rows` long, `partition` string, labels struct<`0`: long, `1`: long>")
    plain = lambda p: (lambda q: "t-bank" if q.startswith("t-bank") else q)(p.strip().lower().replace("_", "-"))
    parts = defaultdict(set)
    for g, n, p, _ in data:
        if g and n and p and p.strip():
            parts[g.strip().lower().removeprefix("g:")].add(plain(p))
    g = GroupSplit(df)
    assert {r[0] for r in rows(g.torn())} == {"g:" + k for k, v in parts.items() if len(v) > 1}
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "category string, share double")
    out = g.assign(targets).collect()
    assert len(out) == len({r.group_key for r in out}) == len(parts)
    total, per = sum(r.n for r in out), Counter()
    for r in out:
        per[r.split] += r.n
    assert all(abs(per[s] / total - t) < 0.02 for s, t in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    empty = GroupSplit(df.limit(0))
    assert empty.torn().count() == 0 and empty.assign(targets).count() == 0


def test_ledger_lines_count_once_each(spark):
    at = lambda d, h=0: f"2025-03-{d:02} {h:02}:00:00"
    g = [f"g:{i:020x}" for i in range(4)]
    data = [(g[0], 1, "S-train", (1, None), {f"s{i % 5}": 1}, at(1 + i // 24, i % 24)) for i in range(200)]  # hot: one-row lines
    data += [(g[1], 2, "S-train", (2, 0), {"a": 1, "b": 1}, at(1)), (g[1].upper(), 2, " s_train", (2, None), {"b": 1, "a": 1}, at(1)), (g[1], 2, "S-train", (2, 0), {"c": 2}, at(1, 5))]
    data += [(g[2], 3, "S-train", (3, 0), {"a": 3}, at(2)), (g[2], 3, "S-train", (3, 0), {"a": 3}, at(20)), (g[2], 4, "S-train", (0, 4), {"a": 4}, at(2, 7))]  # late repeat
    data += [(g[3], 1, "S-train", (1, 0), None, at(3)), (g[3], 1, "S-train", (1, 0), None, at(28)), (g[3], 1, "S-test", (0, 1), None, None)]
    df = spark.createDataFrame([(*r[:5], r[5]) for r in data], "`group` string, `rows` long, `partition` string, labels struct<`0`: long, `1`: long>, sources map<string, long>, recorded_at string")
    out = GroupSplit(df).records.groupBy("group_key").agg(F.sum("n"), F.sum("positive"))
    assert rows(out) == [(g[0], 200, 0), (g[1], 4, 0), (g[2], 7, 4), (g[3], 2, 1)]


def test_labels_are_alike_in_all_splits(spark):
    rng = random.Random(18)
    data = []
    for i in range(3000):  # 60 large groups hold half of the rows and few positives
        n = rng.randrange(80, 120) if i < 60 else rng.choice((1, 2, 3))
        p = sum(rng.random() < (0.1 if i < 60 else 0.4) for _ in range(n))
        data.append((f"g:{i:020x}", n, "S-train", (n - p, p)))
    data.append((f"g:{9999:020x}", 6000, "S-train", (6000, 0)))  # one group and one label for a third
    df = spark.createDataFrame(data, "`group` string, `rows` long, `partition` string, labels struct<`0`: long, `1`: long>")
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "category string, share double")
    positives = {g: y[1] for g, _, _, y in data}
    per, pos = Counter(), Counter()
    for r in GroupSplit(df).assign(targets).collect():
        per[r.split] += r.n
        pos[r.split] += positives[r.group_key]
    total, share = sum(per.values()), sum(pos.values()) / sum(per.values())
    assert all(abs(per[s] / total - t) < 0.01 and abs(pos[s] / per[s] - share) < 0.02 for s, t in (("train", 0.8), ("validation", 0.1), ("test", 0.1))), (per, pos)


def test_entities_tie_groups_together(spark):
    g = [f"g:{i:020x}" for i in range(5)]
    data = [(g[0], 1, "S-train", "ann"), (g[1], 1, "S-test", "ann"), (g[1], 1, "S-test", "bob"), (g[2], 1, "S-test", "bob"), (g[3], 1, "S-test", None), (g[4], 1, "S-train", None), (g[4], 0, "S-train", "ann")]
    df = spark.createDataFrame(data, "`group` string, `rows` long, `partition` string, author string").withColumn("labels", F.lit(None).cast("struct<`0`: long, `1`: long>"))
    tied = GroupSplit(df, entities=["author"])
    assert rows(tied.torn()) == [(x,) for x in g[:3]]
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "category string, share double")
    split = {r.group_key: r.split for r in tied.assign(targets).collect()}
    assert len(split) == 5 and len({split[x] for x in g[:3]}) == 1
    assert rows(GroupSplit(df).torn()) == []


# ---- 7 ----

ODD = ["", "it's I'LL 've''s 'r e", "a  b\n\n c \t\t", " \n", "日本語 text１２³", "<|endoftext|> <|im_start|>", "\x00\x1c\x85 \x7f", "𝒳🔥🔥 é", "a" * 3000 + " " * 500 + "'s" * 40, "don't'S'd'll'x", "１'t", "x   y　z", "�​''"]


def test_ids_equal_the_public_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(9)
    alphabet = "ab 's\n\t1é日'_.-tremlvd  "
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(1500)]
    ids, limits, _, _ = encode_batch(texts, Merger(load_ranks()))
    for i, x in enumerate(texts):
        assert ids[limits[i] : limits[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_long_slices_merge_like_short_ones():
    m = Merger(load_ranks())
    rng = random.Random(10)
    for _ in range(40):
        piece = "".join(rng.choices("abetion ", k=rng.randrange(2, 120))).encode()
        assert m._short(piece) == m._long(piece)


def test_encoding_round_trip(spark):
    data = [(i, t) for i, t in enumerate(ODD)] + [(99, None)]
    df = spark.createDataFrame(data, "doc int, text string").withColumn("ids", F.lit("clash"))
    out = encode(df, "text", ["doc"], offsets=True)
    got = {r.doc: r for r in out.collect()}
    assert got[99].ids == [] and got[0].ids == []
    for i, t in data[:-1]:
        at = got[i].slice_bytes + [len(t.encode())]
        assert at[0] == 0 and at == sorted(at)
    assert dict(rows(decode(out, "ids", ["doc"])))  == {i: t or "" for i, t in data}
    cut = decode(out, "ids", ["doc"], offsets="slice_bytes").collect()
    assert all("".join(r.slices) == r.text and len(r.slices) == len(got[r.doc].slice_bytes) for r in cut)
    assert encode(df.limit(0), "text", ["doc"]).count() == 0


# ---- 8 ----


def test_curve_visits_neighbours():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert(side, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packer_never_overfills():
    rng = random.Random(11)
    p, room, pieces = Packer(100), Counter(), defaultdict(list)
    for w in range(5):
        items = [(rng.randrange(1, 260), (w, i)) for i in range(200)]
        for row, piece, first, n, container in p.window(items):
            room[container] += n
            pieces[row].append((piece, first, n))
        for size, row in items:
            parts = sorted(pieces[row])
            assert sum(n for *_, n in parts) == size and (size > 100 or len(parts) == 1) and [f for _, f, _ in parts] == [100 * k for k in range(len(parts))]
    assert max(room.values()) <= 100 and sum(room.values()) / (100 * p.made) > 0.97


def test_packing(spark):
    rng = random.Random(12)
    data = [(i, " ".join(rng.choices(["guard", "prompt", "river", "the", "7"], k=rng.randrange(0, 90)))) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 2000)]
    kinds = spark.createDataFrame([("small", 64), ("big", 512), ("none", None), ("bad", 0)], "container_kind string, capacity_tokens long")
    df = spark.createDataFrame(data, "id int, text string").withColumn("tokens", F.lit(0))
    out = pack(df, "id", "text", kinds)
    got = out.collect()
    used = Counter()
    for r in got:
        used[r.container_kind, r.container] += r.tokens
    assert {k for k, c in used if c is not None} == {"small", "big"}
    assert all(n <= {"small": 64, "big": 512}[k] for (k, c), n in used.items() if c is not None)
    assert {r.id for r in got if r.container is None} >= {900, 901} and len({(r.container_kind, r.id) for r in got}) == 2 * len(data)
    assert all(r.fill > 0.9 for r in fill(out, kinds).collect())
    again = pack(df.repartition(1), "id", "text", kinds)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    assert rows(again.select("container_kind", "id", "piece", "container").fillna(-1)) == sorted((r.container_kind, r.id, r.piece, -1 if r.container is None else r.container) for r in got)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pack(df.limit(0), "id", "text", kinds).count() == 0


# ---- 9 ----


def _page(rng, kind):
    name = lambda: "".join(rng.choices("abcdefghijklmnoprstuvwz", k=rng.randrange(3, 9)))
    prose = lambda k: " ".join("The " + " ".join(name() for _ in range(11)) + "." for _ in range(k))
    words = ["buy", "cheap", "guard", "best", "price", "online", "shield"]
    if kind == "prose":
        return prose(12)
    if kind == "repeated":
        return (prose(1) + " ") * 15
    if kind == "keywords":
        return " ".join(rng.choices(words, k=200))
    if kind == "links":
        return "\n".join(f"https://{rng.choice(words)}{rng.randrange(999)}.example.com/{rng.randrange(10**6)}?id={rng.randrange(10**6)}" for _ in range(25))
    if kind == "tags":
        return " ".join(f"#{a}{b}{rng.randrange(99)}" for a in words for b in words)
    if kind == "log":
        return "\n".join('{"step": %d, "tool": "mail", "result": "%s", "ms": %d}' % (rng.randrange(99), prose(1), rng.randrange(9999)) for _ in range(10))
    if kind == "few links":
        return "\n".join(f"https://a{i}.example.com/x\n{prose(2)}" for i in range(6))
    return "\n".join(f"def f{i}(text, limit={i}):\n    # {prose(1)}\n    return text[:limit]" for i in range(8))


def test_stuffed_pages(spark):
    rng = random.Random(13)
    kinds = ["prose", "prose", "repeated", "keywords", "links", "tags", "log", "few links", "code", "prose", "prose", "prose"]
    data = [(i, _page(rng, kinds[i % 12]), rng.choice(["en", "EN", None, "xx1"])) for i in range(240)]
    data += [(900, None, "en"), (901, "", "en"), (902, " \n ", None), (903, "buy", "en"), (904, _page(rng, "keywords") + ". " + _page(rng, "prose") * 2, "en")]
    df = spark.createDataFrame(data, "id int, text string, lang string").withColumn("ratio", F.lit(0))
    found = {r.id for r in stuffed_pages(df, "id", "text", "lang").collect()}
    assert found == {i for i in range(240) if kinds[i % 12] in ("keywords", "links", "tags")}
    assert stuffed_pages(df.limit(0), "id", "text", "lang").count() == 0


def test_stuffed_pages_where_prose_is_rare(spark):
    # real sentences in one page of twenty, so that the usual ratio hardly comes from the corpus
    plain = ["The guard reads every message before it reaches the model, and writes a short note about what it saw.", "Nobody on the team had expected the new filter to refuse so many harmless questions from students.", "When the report came back in the evening, we compared both lists and found three differences between them.", "A longer answer is not always a better one, as the second experiment of this winter showed quite clearly."]
    rng = random.Random(14)
    data = [(i, "\n".join(rng.sample(plain, 4)) if i % 20 == 0 else _page(rng, ("keywords", "links", "tags", "code", "log")[i % 5]), "en") for i in range(100)]
    data += [(901, "cheap vpn, cheap vpn, best vpn, free vpn, cheap vpn", "en"), (902, "#a1 #b2 #c3 #d4 #e5 #f6", None), (903, "buy", "en"), (904, "Ok, thanks", "en"), (905, "buy " * 8, "de"), (906, "\u2028\U0001f512", "en")]
    found = {r.id for r in stuffed_pages(spark.createDataFrame(data, "id int, text string, lang string"), "id", "text", "lang").collect()}
    assert found == {i for i in range(100) if i % 20 and i % 5 < 3} | {901, 902, 905}


def test_blocks_cover_the_text():
    t = "One two three four five six seven eight nine. " * 60 + "see https://a.example.com/b #tag"
    parts = blocks(t)
    assert len(parts) > 1 and abs(sum(b[1] for b in parts) - len(t)) < 80


def test_usual_ratio_has_no_step(spark):
    df = spark.createDataFrame([(n, 0.3 if n else None, n or None) for n in range(0, 400)], "i int, own double, n long")
    got = [r[0] for r in df.orderBy("i").select(usual_ratio(F.col("own"), F.col("n"), F.lit(0.5))).collect()]
    assert got[0] == 0.5 and all(0 < a - b < 0.003 for a, b in zip(got, got[1:])) and got[-1] < 0.35
