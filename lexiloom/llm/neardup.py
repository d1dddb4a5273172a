"""Near-duplicates with small edits (problem 2): Bayesian verification of banded signatures.

Two texts are near-duplicates if they share at least ``share`` of their words,
counted with repeats and in any order, of the longer text's words.

1. Document frequencies of all words are counted over all texts.  Words in more
   than ``RARE`` of the texts, the MOST_WORDS most frequent of them at most, are
   broadcast with their weight, the logarithm of the inverse frequency to the power
   POWER; all others have the weight of RARE.  Weights only steer which pairs become
   candidates.
2. Every distinct text gets BANDS bucket hashes of ROWS weighted minhashes each
   (candidates), and 64 plain minhashes of its bag of words in four batches of
   16, 4 bits each (verification).
3. Texts in one bucket are candidates.  Batch by batch the pair's posterior
   probability of being similar enough is looked up; the pair is dropped where
   that is below MISS.  The first two batches travel with the bucket rows, so
   most candidates go before any further shuffle.  The bands are done in PASSES
   runs, and a run's shuffle is deleted before the next one begins: the bucket rows
   of all bands, three times the texts, are never on disk together.
4. Survivors are verified exactly on their whole bags of words: 48-bit hashes of
   (word, number of its occurrence).

The necessary bag similarity (Jaccard) of a pair follows from its lengths; it
lies between share / (2 - share) and share.  Copies are done once: every step
works on distinct word sequences.  Signatures are written once a partition; only
those of word sequences that may repeat, by a Bloom filter of the repeats that
problem 4 has found, are shuffled to have each once.

A bucket may be hot.  Both sides of the bucket join come straight from an exchange, so
that adaptive execution splits a skewed partition of either side among tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrowkit import lists, texts_of
from ..functions.wordkernel import Words, mix64, occurrence_numbers, seeded, split_words
from ..scratch import Scratch
from . import bloom

SHARE = 0.75
BANDS, ROWS = 48, 5
BATCHES, PER_BATCH = 4, 16
#: Runs of bands whose bucket rows are on disk at a time.
PASSES = 8
MISS = 0.002
RARE = 1e-4
#: Words that are broadcast at most (12 bytes each).
MOST_WORDS = 1 << 20
POWER = 0.5

_NIBBLES = 0x1111111111111111
_LOW = 0xFFFFFFFF


@lru_cache
def reachable(matches_of: int) -> tuple[float, ...]:
    """For m = 0..matches_of equal 4-bit minhashes of that many: the largest
    similarity t whose posterior probability P(J >= t | m) is at least MISS.

    A hash agrees with probability J + (1 - J) / 16; the prior of J is uniform.
    """
    j = np.linspace(0, 1, 4001)
    p = np.clip(j + (1 - j) / 16, 1e-12, 1 - 1e-12)
    out = []
    for m in range(matches_of + 1):
        log = m * np.log(p) + (matches_of - m) * np.log1p(-p)
        mass = np.exp(log - log.max())
        tail = np.cumsum(mass[::-1])[::-1] / mass.sum()
        out.append(float(j[np.flatnonzero(tail >= MISS)[-1]]))
    return tuple(out)


def _agreeing(a: Column, b: Column) -> Column:
    """Equal 4-bit values of two longs that hold 16 each."""
    x = a.bitwiseXOR(b)
    y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
    return F.lit(PER_BATCH) - F.bit_count(y.bitwiseAND(F.lit(_NIBBLES)))


def _possible(m: Column, of: int, needed: Column) -> Column:
    table = F.array(*[F.lit(x) for x in reachable(of)])
    return F.element_at(table, m.cast("int") + 1) >= needed


def needed_similarity(a: Column, b: Column, share: float = SHARE) -> Column:
    """Bag similarity that a pair with these word counts must have."""
    long = F.greatest(a, b)
    return F.lit(share) * long / (a + b - F.lit(share) * long)


def word_weights(texts: DataFrame, text: str, n_texts: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in at least RARE of the texts, sorted, and their weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            words = np.concatenate([a for a, _ in held])
            u, at = np.unique(words, return_inverse=True)
            n = np.bincount(at, np.concatenate([b for _, b in held]), len(u)).astype(np.int64)
            held[:] = [(u, n)]
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for w in split_words(texts_of(batch.column(0))):
                h, d = w.hashes(0), w.doc()
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                if len(h):
                    held.append(np.unique(h[fresh], return_counts=True))
            if sum(len(a) for a, _ in held) > 2_000_000:
                out = flush()
                if out.num_rows > 1_000_000:
                    held.clear()
                    yield out
        if held:
            yield flush()

    counted = texts.select(text).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    held = scratch.keep(counted.where(F.col("n") >= F.lit(RARE * n_texts)))  # mean words / RARE rows
    common = (held if held.count() <= MOST_WORDS else held.orderBy(F.desc("n"), "word").limit(MOST_WORDS)).toPandas()
    scratch.drop(held)
    words, n = common["word"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(float)
    order = np.argsort(words)
    return words[order], (np.maximum(-np.log(n[order] / max(1, n_texts)), 1e-3) ** POWER).astype(np.float32)


def _mixed(tok: np.ndarray, salt: np.uint64) -> np.ndarray:
    a, b = np.uint32(salt & np.uint64(0xFFFFFFFF)) | np.uint32(1), np.uint32(salt >> np.uint64(32)) | np.uint32(1)
    u = tok * a
    u ^= u >> np.uint32(15)
    u *= b
    u ^= u >> np.uint32(16)
    return u


class Signer:
    """Signatures of the texts of a run."""

    def __init__(self, common: np.ndarray, weights: np.ndarray) -> None:
        self.common, self.weights = common, weights
        self.rare = np.float32((-np.log(RARE)) ** POWER)
        self.salts = seeded(0x2545F491, BANDS * ROWS + BATCHES * PER_BATCH)

    def bag(self, w: Words, hashed: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the picked texts: word hashes, bag elements and offsets."""
        counts = w.counts
        inside = np.repeat(pick, counts)
        h = hashed[inside]
        n = counts[pick]
        doc = np.repeat(np.arange(len(n)), n)
        number = occurrence_numbers(doc, h).astype(np.uint64)
        with np.errstate(over="ignore"):
            element = mix64(h + number * np.uint64(0x9E3779B97F4A7C15))
        return h, element, np.concatenate(([0], np.cumsum(n)))

    def sign(self, words: np.ndarray, element: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket hashes (texts x BANDS, 32 bits: two that are equal by chance only make
        a candidate) and batches (texts x BATCHES)."""
        at, n = limits[:-1], len(limits) - 1
        tok = (element >> np.uint64(32)).astype(np.uint32)
        lighter = np.full(len(words), 1 / self.rare, np.float32)
        if len(self.common):
            place = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
            known = self.common[place] == words
            lighter[known] = 1 / self.weights[place[known]]
        buckets = np.empty((n, BANDS), np.uint32)
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                h = np.full(n, band, np.uint64)
                for r in range(ROWS):
                    least = np.minimum.reduceat(_mixed(tok, self.salts[band * ROWS + r]).astype(np.float32) * lighter, at)
                    h = mix64(h * np.uint64(31) + least.view(np.uint32).astype(np.uint64))
                buckets[:, band] = h >> np.uint64(32)
            batches = np.zeros((n, BATCHES), np.uint64)
            for k in range(BATCHES * PER_BATCH):
                least = np.minimum.reduceat(_mixed(tok, self.salts[BANDS * ROWS + k]), at)
                nibble = mix64(least.astype(np.uint64) + np.uint64(k)) & np.uint64(15)
                batches[:, k // PER_BATCH] |= nibble << np.uint64(4 * (k % PER_BATCH))
        return buckets, batches


def _first_of_partition(seen: set[int], keys: np.ndarray, ok: np.ndarray) -> np.ndarray:
    pick = np.zeros(len(keys), bool)
    for i in np.flatnonzero(ok):
        k = int(keys[i])
        if k not in seen:
            seen.add(k)
            pick[i] = True
    return pick


def signatures(df: DataFrame, text: str, common: np.ndarray, weights: np.ndarray, repeats: bloom.Filter) -> DataFrame:
    """(key, n, s1..s4, twin, run0, run1, ..) once in a partition for each distinct word
    sequence; key is its 64-bit hash, twin tells that it may occur in other partitions
    too, a run holds the buckets of its bands."""
    held = df.sparkSession.sparkContext.broadcast((common, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = Signer(*held.value), set()
        for batch in batches:
            for w in split_words(texts_of(batch.column(0))):
                key = w.sequence_hashes(w.hashes(1), 1)
                pick = _first_of_partition(seen, key, w.counts > 0)
                if not pick.any():
                    continue
                h, element, limits = signer.bag(w, w.hashes(0), pick)
                buckets, batched = signer.sign(h, element, limits)
                n = len(limits) - 1
                columns = [pa.array(key[pick].view(np.int64)), pa.array(np.diff(limits).astype(np.int32))]
                columns += [pa.array(np.ascontiguousarray(batched[:, k]).view(np.int64)) for k in range(BATCHES)]
                columns.append(pa.array(repeats.holds(key[pick])))
                columns += [lists(part.view(np.int32).ravel(), np.arange(n + 1) * part.shape[1], pa.int32()) for part in map(np.ascontiguousarray, np.array_split(buckets, PASSES, axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", *_SIGS, "twin", *_RUNS])

    return df.select(text).mapInArrow(run, "key bigint, n int, " + ", ".join(f"{s} bigint" for s in _SIGS) + ", twin boolean, " + ", ".join(f"{r} array<int>" for r in _RUNS))


_SIGS = [f"s{k + 1}" for k in range(BATCHES)]
_RUNS = [f"run{k}" for k in range(PASSES)]


def bags(df: DataFrame, text: str, wanted: bloom.Filter, repeats: bloom.Filter) -> DataFrame:
    """(key, bag, twin) once in a partition for each word sequence that may be wanted; a
    bag holds 48-bit hashes in ascending order."""
    none = np.empty(0, np.uint64), np.empty(0, np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = Signer(*none), set()
        for batch in batches:
            for w in split_words(texts_of(batch.column(0))):
                key = w.sequence_hashes(w.hashes(1), 1)
                pick = _first_of_partition(seen, key, (w.counts > 0) & wanted.holds(key))
                if not pick.any():
                    continue
                _, element, limits = signer.bag(w, w.hashes(0), pick)
                short = element >> np.uint64(16)
                short = short[np.lexsort((short, np.repeat(np.arange(len(limits) - 1), np.diff(limits))))]
                raw = np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                bag = pa.Array.from_buffers(pa.binary(), len(limits) - 1, [None, pa.py_buffer((limits * 6).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(key[pick].view(np.int64)), bag, pa.array(repeats.holds(key[pick]))], ["key", "bag", "twin"])

    return df.select(text).mapInArrow(run, "key bigint, bag binary, twin boolean")


def shared_words(a: bytes, b: bytes) -> int:
    """Elements that two bags share."""
    x, y = (np.frombuffer(v, np.uint16).reshape(-1, 3).astype(np.uint64) for v in (a, b))
    x, y = (v[:, 0] | v[:, 1] << np.uint64(16) | v[:, 2] << np.uint64(32) for v in (x, y))
    return len(np.intersect1d(x, y, assume_unique=True))


def _alike(pairs: DataFrame, share: float) -> DataFrame:
    """(key_a, key_b) of the pairs (..., n_a, n_b, bag_a, bag_b) that share enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.maximum(batch.column("n_a").to_numpy(zero_copy_only=False), batch.column("n_b").to_numpy(zero_copy_only=False))
            both = np.fromiter((shared_words(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("bag_a"), batch.column("bag_b"))), np.int64, batch.num_rows)
            yield batch.select(["key_a", "key_b"]).filter(pa.array(both >= share * n))

    return pairs.select("key_a", "key_b", "n_a", "n_b", "bag_a", "bag_b").mapInArrow(run, "key_a bigint, key_b bigint")


def _bucket_pairs(once: DataFrame, run: str, share: float) -> DataFrame:
    """(key_a, key_b) of the texts that share a bucket of the run and may be similar
    enough by their lengths and first two batches; a pair comes once for each such bucket."""
    # a bucket and the length share a long: the rows are what fills the disk
    tag = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("bucket").cast("long").bitwiseAND(F.lit(_LOW)))
    rows = once.select(F.explode(run).alias("bucket"), "key", "n", "s1", "s2").select(tag.alias("tag"), "key", "s1", "s2")
    bucket = lambda x: F.col(f"{x}.tag").bitwiseAND(F.lit(_LOW))
    n_a, n_b = (F.shiftright(F.col(f"{x}.tag"), 32) for x in "ab")
    need = needed_similarity(n_a, n_b, share)
    fits = (F.col("a.key") < F.col("b.key")) & (F.least(n_a, n_b) >= F.lit(share) * F.greatest(n_a, n_b))
    first = _agreeing(F.col("a.s1"), F.col("b.s1"))
    second = first + _agreeing(F.col("a.s2"), F.col("b.s2"))
    alike = _possible(first, PER_BATCH, need) & _possible(second, 2 * PER_BATCH, need)
    banded = rows.alias("a").join(rows.alias("b"), (bucket("a") == bucket("b")) & fits & alike)
    return banded.select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))


def near_pairs(df: DataFrame, text: str, n_texts: int, repeats: DataFrame, scratch: Scratch, share: float = SHARE) -> DataFrame:
    """(key_a, key_b): near-duplicate pairs of distinct word sequences, each once.
    ``repeats``: (key) of every word sequence that occurs in two or more rows."""
    common, weights = word_weights(df, text, n_texts, scratch)
    repeated = bloom.build(repeats, "key", repeats.count(), repeated=False)
    signed = scratch.keep(signatures(df, text, common, weights, repeated))
    twins = scratch.keep(signed.where("twin").dropDuplicates(["key"]))
    once = signed.where("not twin").unionByName(twins)

    banded = [scratch.keep(_bucket_pairs(once, run, share)) for run in _RUNS]
    # one exchange by key_a serves both the removal of repeats and the next join
    pairs = reduce(DataFrame.unionByName, banded).repartition("key_a").dropDuplicates(["key_a", "key_b"])

    side = lambda x: once.select(F.col("key").alias(f"key_{x}"), F.col("n").alias(f"n_{x}"), *[F.col(s).alias(f"{s}_{x}") for s in _SIGS])
    known = pairs.join(side("a"), "key_a").join(side("b"), "key_b")
    need = needed_similarity(F.col("n_a"), F.col("n_b"), share)
    agree = F.lit(0)
    keep = F.lit(True)
    for k, s in enumerate(_SIGS):
        agree = agree + _agreeing(F.col(f"{s}_a"), F.col(f"{s}_b"))
        keep = keep & _possible(agree, PER_BATCH * (k + 1), need)
    survivors = scratch.keep(known.where(keep).select("key_a", "key_b", "n_a", "n_b"))
    scratch.drop(signed, twins, *banded)

    ends = survivors.select(F.explode(F.array("key_a", "key_b")).alias("key"))
    wanted = bloom.build(ends, "key", max(1, 2 * survivors.count()), repeated=False)
    found = scratch.keep(bags(df, text, wanted, repeated))
    twins = scratch.keep(found.where("twin").dropDuplicates(["key"]))  # written, so that both joins share an exchange
    held = found.where("not twin").unionByName(twins)
    bag = lambda x: held.select(F.col("key").alias(f"key_{x}"), F.col("bag").alias(f"bag_{x}"))
    out = scratch.keep(_alike(survivors.join(bag("a"), "key_a").join(bag("b"), "key_b"), share))
    scratch.drop(survivors, found, twins)
    return out
