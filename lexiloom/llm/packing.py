"""Filling fixed-capacity containers along a space-filling curve (problem 8).

1. In one pass over the texts: size in tokens of a public tokenizer, and a hashed
   word vector projected to DIMS dimensions with signs taken from the word hashes.
2. The projection's place on a Hilbert curve is the sort key: documents are range
   partitioned and sorted by it, so that similar documents are neighbours.
3. Each range is packed window by window: the window's items, longest first, go
   into the fullest open container that still has room (best fit decreasing), and
   containers stay open for the next windows along the curve.

An item longer than the capacity fills whole containers and its rest is packed as
an item; no other item is divided.

Defined results: null and empty texts have 0 tokens and stand in no container
(container null); equal texts are separate items; containers with a null or
non-positive capacity are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowkit import texts_of
from ..functions.wordkernel import mix64, split_words
from ..scratch import Scratch
from .tokenize import VOCABULARY, Merger, load_ranks, slices

DIMS, BITS = 3, 10
WINDOW = 1024
#: Containers kept open at most; the fullest are closed first.
OPEN = 1024
#: Documents of a range of the curve.
RANGE_DOCS = 20_000
#: Kinds of containers that may be asked for at once.
MOST_KINDS = 1000


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2**bits.

    The public transpose form of Skilling (2004), vectorised over rows.
    """
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[str | None]) -> np.ndarray:
    """Hilbert key of each text's projected word vector."""
    out = np.zeros(len(texts), np.int64)
    for w in split_words(texts):
        h = mix64(w.hashes(0))
        n = w.counts
        place = np.zeros((w.n_texts, DIMS))
        some = n > 0
        for k in range(DIMS):
            sign = ((h >> np.uint64(7 + k)) & np.uint64(1)).astype(float) * 2 - 1
            total = np.concatenate(([0.0], np.cumsum(sign)))
            place[:, k] = total[w.word_from[1:]] - total[w.word_from[:-1]]
        place[some] /= np.sqrt(n[some])[:, None]
        unit = 1 / (1 + np.exp(-1.702 * place))  # close to the normal distribution function
        axes = np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        out[w.first : w.first + w.n_texts] = hilbert(axes)
    return out


def sized(df: DataFrame, id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, tokens, curve) of every row."""
    held = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    source = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = texts_of(batch.column("text"))
            counts = []
            for s in slices(texts):
                size = np.fromiter((len(merger[p]) for p in s.pieces()), np.int64, len(s.start))
                upto = np.concatenate(([0], np.cumsum(size)))
                counts.append(np.diff(upto[s.slice_from]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(counts)), pa.array(curve_keys(texts))], ["id", "tokens", "curve"])

    return source.mapInArrow(run, f"id {kind}, tokens bigint, curve bigint")


class Packer:
    """Open containers of one kind."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.open: list[tuple[int, int]] = []  # (room, container), sorted

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def window(self, items: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Places (row, piece, first token, tokens, container) of items (tokens, row)."""
        out, rest = [], []
        for size, row in items:
            whole = size // self.capacity if size > self.capacity else 0
            for k in range(whole):
                out.append((row, k, k * self.capacity, self.capacity, self._new()))
            left = size - whole * self.capacity
            if left:
                rest.append((left, row, whole))
        rest.sort(key=lambda x: -x[0])
        for size, row, piece in rest:
            i = bisect_left(self.open, (size, -1))
            room, container = self.open.pop(i) if i < len(self.open) else (self.capacity, self._new())
            out.append((row, piece, piece * self.capacity, size, container))
            if room > size:
                insort(self.open, (room - size, container))
        del self.open[:-OPEN]
        return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of WINDOW rows, wherever Arrow batches end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= WINDOW:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, WINDOW)
            held = whole.slice(WINDOW).to_batches()
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def pack(df: DataFrame, id: str, text: str, kinds: DataFrame, kind: str = "container_kind", capacity: str = "capacity_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for every piece of every text and kind of container:
    (container_kind, container, id, piece, first_token, tokens, place); place numbers the
    documents along the curve."""
    scratch = Scratch(df.sparkSession)
    wanted = sorted((r[0], int(r[1])) for r in kinds.where(F.col(kind).isNotNull() & (F.col(capacity) > 0)).select(kind, capacity).distinct().limit(MOST_KINDS + 1).collect())
    if len(wanted) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    items = scratch.keep(sized(df, id, text, vocabulary))
    ranges = max(1, -(-items.count() // RANGE_DOCS))
    along = items.repartitionByRange(ranges, "curve", "id").sortWithinPartitions("curve", "id").select("id", "tokens", F.spark_partition_id().alias("part"))
    id_type = items.schema["id"].dataType.simpleString()
    names = ["container_kind", "container", "id", "piece", "first_token", "tokens", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers, begin = [Packer(c) for _, c in wanted], 0
        for part in _windows(batches):
            size = part.column("tokens").to_pylist()
            base = part.column("part")[0].as_py() << 40
            for (name, _), packer in zip(wanted, packers):
                placed = packer.window([(s, i) for i, s in enumerate(size) if s])
                placed += [(i, 0, 0, 0, -1) for i, s in enumerate(size) if not s]
                p = np.array(placed, np.int64)
                container = pa.array(np.where(p[:, 4] < 0, 0, base + p[:, 4]), mask=p[:, 4] < 0)
                columns = [pa.array([name] * len(p)), container, part.column("id").take(pa.array(p[:, 0])).combine_chunks(), pa.array(p[:, 1].astype(np.int32)), pa.array(p[:, 2]), pa.array(p[:, 3]), pa.array(base + begin + p[:, 0])]
                yield pa.RecordBatch.from_arrays(columns, names)
            begin += part.num_rows

    return along.mapInArrow(run, f"container_kind string, container bigint, id {id_type}, piece int, first_token bigint, tokens bigint, place bigint")


def fill(packed: DataFrame, kinds: DataFrame, kind: str = "container_kind", capacity: str = "capacity_tokens") -> DataFrame:
    """(container_kind, containers, tokens, fill, span): the share of the containers' room
    that is used, and the mean over containers of the distance, in documents along the
    curve, between their first and last document."""
    each = packed.where("container is not null").groupBy("container_kind", "container").agg(F.sum("tokens").alias("tokens"), (F.max("place") - F.min("place")).alias("span"))
    used = each.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.avg("span"), 1).alias("span"))
    room = kinds.groupBy(F.col(kind).alias("container_kind")).agg(F.max(capacity).alias("room"))
    return used.join(F.broadcast(room), "container_kind").select("container_kind", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("room")), 6).alias("fill"), "span")
