"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

Pre-tokenisation uses no regular expression.  Every code point has a class; a
class acts on the states of a small automaton, and these actions generate a
finite monoid whose product is associative.  So the automaton is run over a whole
batch by a blocked prefix scan over a product table, which gives the state before
every code point and with it the slice boundaries.  Slices then go through pair
merging with a cache.

Defined results: null and empty texts have no ids; strings that look like special
tokens are ordinary text; bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowkit import lists, texts_of

#: Where the public vocabularies are; a parameter everywhere below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK_CHARS = 1 << 20
#: Slices kept with their ids in a Python worker, and the longest slice kept.
CACHE_SLICES, CACHE_BYTES = 200_000, 64

# Code point classes.  A2 and A3 are apostrophes followed by a contraction of one
# or two letters, SP a space before a non-space, WL another white space character
# before one, WS white space before white space or the end, X a text's end.
L, N, O, A2, A3, SP, WL, WS, X = range(9)
# States: inside letters, numbers, others; after SP; in white space; one or two
# contraction letters to come; slice ended.
IN_L, IN_N, IN_O, AFTER_SP, IN_WS, C1, C2, END = range(8)

#: The code points that are white space.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """State after a code point of this class, and whether it goes on with the slice."""
    if kind == L:
        if state == C2:
            return C1, True
        if state == C1:
            return END, True
        return IN_L, state in (IN_L, AFTER_SP)
    if kind == N:
        return IN_N, state in (IN_N, AFTER_SP)
    if kind in (O, A2, A3):
        run = state in (IN_O, AFTER_SP)
        return (IN_O if run or kind == O else C1 if kind == A2 else C2), run
    if kind == SP:
        return AFTER_SP, False
    if kind == WL:
        return END, False
    if kind == WS:
        return IN_WS, state == IN_WS
    return END, False


class Monoid:
    """The maps of states that sequences of classes cause, as a product table."""

    def __init__(self) -> None:
        basis = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
        known = {tuple(range(8)): 0}
        queue = [tuple(range(8))]
        for f in queue:
            for g in basis:
                h = tuple(g[f[s]] for s in range(8))
                if h not in known:
                    known[h] = len(known)
                    queue.append(h)
        self.size = len(queue)
        self.acts = np.array(queue, np.uint8)
        self.generator = np.array([known[g] for g in basis], np.uint16)
        self.product = np.array([[known[tuple(g[f[s]] for s in range(8))] for g in queue] for f in queue], np.uint16)
        self.goes_on = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])

    def scan(self, x: np.ndarray) -> np.ndarray:
        """Inclusive prefix products of x."""
        n = len(x)
        if n <= 64:
            out = x.copy()
            for i in range(1, n):
                out[i] = self.product[out[i - 1], out[i]]
            return out
        steps = 64
        blocks = -(-n // steps)
        grid = np.zeros(blocks * steps, np.uint16)
        grid[:n] = x
        grid = np.ascontiguousarray(grid.reshape(blocks, steps).T)
        flat = self.product.ravel()
        size = np.int64(self.size)
        for i in range(1, steps):
            grid[i] = flat[grid[i - 1] * size + grid[i]]
        before = np.zeros(blocks, np.uint16)
        before[1:] = self.scan(grid[-1])[:-1]
        grid = flat[before[None, :] * size + grid]
        return grid.T.ravel()[:n]


@lru_cache(1)
def _monoid() -> Monoid:
    return Monoid()


@lru_cache(1)
def _kinds() -> np.ndarray:
    """L, N, O or WS of every code point."""
    major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), "S1")
    out = np.full(0x110000, O, np.uint8)
    out[major == b"L"], out[major == b"N"] = L, N
    out[list(WHITE_SPACE)] = WS
    return out


def classify(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of the code points; ends are the places of the texts' ends."""
    kind = _kinds()[codes]
    kind[ends] = X
    after = np.append(kind[1:], np.uint8(X))
    last = (kind == WS) & (after != WS) & (after != X)
    kind[last] = np.where(codes[last] == 0x20, SP, WL)
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        at = lambda k: np.where(quote + k < len(codes), codes[np.minimum(quote + k, len(codes) - 1)], 0)
        one, two = at(1), at(2)
        kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = A2
        pair = lambda a, b: (one == ord(a)) & (two == ord(b))
        kind[quote[pair("r", "e") | pair("v", "e") | pair("l", "l")]] = A3
    return kind


def boundaries(kind: np.ndarray) -> np.ndarray:
    """True where a slice begins; text ends count as slices of their own."""
    m = _monoid()
    state = np.empty(len(kind), np.uint8)
    state[0] = END
    if len(kind) > 1:
        state[1:] = m.acts[m.scan(m.generator[kind[:-1]]), END]
    return ~m.goes_on[state, kind]


class Merger(dict):
    """Slice (bytes) -> token ids, filled on demand by merging pairs in rank order."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        known = self.ranks.get(piece)
        ids = (known,) if known is not None else tuple(self.ranks[p] for p in (self._short(piece) if len(piece) <= 48 else self._long(piece)))
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_SLICES:
                self.clear()
            self[piece] = ids
        return ids

    def _short(self, piece: bytes) -> list[bytes]:
        get = self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        joint = [get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while joint:
            least = min(joint)
            if least == 1 << 30:
                break
            i = joint.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
            if i < len(joint):
                joint[i] = get(parts[i] + parts[i + 1], 1 << 30)
        return parts

    def _long(self, piece: bytes) -> list[bytes]:
        """The same in O(n log n): a heap of candidate pairs over a linked list."""
        get, n = self.ranks.get, len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j], after[i] = None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (m := after[k]) < n and (r := get(part[k] + part[m])) is not None:
                    heapq.heappush(heap, (r, k, len(part[k]) + len(part[m])))
        return [p for p in part if p is not None]


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id of a rank file: a base64 token and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Slices:
    """Slices of a run of texts."""

    def __init__(self, first: int, texts: list[str]) -> None:
        self.first, self.n = first, len(texts)
        whole = "\n".join(texts) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens + 1) - 1
        begin = np.flatnonzero(boundaries(classify(codes, ends)))
        width = np.ones(len(codes), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += codes >= limit
        byte = np.concatenate(([0], np.cumsum(width)))
        limits = np.append(byte[begin], byte[-1])
        real = ~np.isin(begin, ends, assume_unique=True)
        self.start, self.stop = limits[:-1][real], limits[1:][real]
        self.text_byte = np.concatenate(([0], byte[ends + 1]))
        self.slice_from = np.concatenate(([0], np.cumsum(real)))[np.searchsorted(begin, np.concatenate(([0], ends + 1)))]
        self.bytes = whole.encode("utf-8", "surrogatepass")

    def pieces(self) -> list[bytes]:
        raw = self.bytes
        return [raw[s:e] for s, e in zip(self.start.tolist(), self.stop.tolist())]


def slices(texts: list[str | None]) -> Iterator[Slices]:
    filled = [t or "" for t in texts]
    total = np.concatenate(([0], np.cumsum([len(t) + 1 for t in filled])))
    at = 0
    while at < len(filled):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK_CHARS, "right")) - 1)
        yield Slices(at, filled[at:to])
        at = to


def encode_batch(texts: list[str | None], merger: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts and their offsets; first byte of each slice in its text, as
    offsets per text, and the offsets of the texts in those."""
    ids, counts, offsets, pieces = [], [], [], []
    for s in slices(texts):
        found = [merger[p] for p in s.pieces()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(upto[-1])))
        counts.append(np.diff(upto[s.slice_from]))
        per = np.diff(s.slice_from)
        offsets.append(s.start - np.repeat(s.text_byte[:-1], per))
        pieces.append(per)
    limit = lambda x: np.concatenate(([0], np.cumsum(np.concatenate(x))))
    return np.concatenate(ids), limit(counts), np.concatenate(offsets), limit(pieces)


def encode(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """The kept columns and ``ids`` of each text; with ``offsets`` also ``slice_bytes``, the
    byte offset of each slice in its text, at which ``decode`` cuts the text again."""
    held = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    source = df.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", ids array<int>" + ", slice_bytes array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(held.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, limits, at, per = encode_batch(texts_of(batch.column("_text")), merger)
            columns = [batch.column(i) for i in range(len(keep))] + [lists(ids, limits, pa.int32())] + [lists(at.astype(np.int32), per, pa.int32())] * offsets
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids"] + ["slice_bytes"] * offsets)

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, keep: list[str], vocabulary: str = VOCABULARY, offsets: str | None = None) -> DataFrame:
    """The kept columns and ``text``, the UTF-8 text of the ids; null ids give null.  With
    a column of slice offsets also ``slices``, the text cut at these."""
    held = df.sparkSession.sparkContext.broadcast({i: b for b, i in load_ranks(vocabulary).items()})
    source = df.select(*[F.col(c) for c in keep], F.col(ids).alias("_ids"), *([F.col(offsets).alias("_at")] if offsets else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]) + ", text string" + ", slices array<string>" * bool(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = held.value.__getitem__
        for batch in batches:
            raw = [None if x is None else b"".join(map(token, x)) for x in batch.column("_ids").to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.string())]
            if offsets:
                cuts = batch.column("_at").to_pylist()
                parts = [None if x is None or at is None else [x[i:j].decode("utf-8", "replace") for i, j in zip(at, [*at[1:], len(x)])] for x, at in zip(raw, cuts)]
                columns.append(pa.array(parts, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text"] + ["slices"] * bool(offsets))

    return source.mapInArrow(run, schema)
