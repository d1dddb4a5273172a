"""Blocked Bloom filters over 64-bit hashes, built in partitions and merged block by block.

Two filters are kept per block of the hash space: hashes seen once and hashes
seen repeatedly.  A partition marks its own repeats; merging marks every bit that
two partitions share.  Bits that are shared by chance only add false positives:
a hash seen twice is never missed, which makes the filter a safe pre-selection
for an exact step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.wordkernel import mix64

BLOCK_BITS = 1 << 19
PROBES = 4
#: Bits a hash gets, and the most bits one filter may have: 32 MB are broadcast at most.
BITS_PER_HASH = 10
MOST_BLOCKS = 512
_SCHEMA = "block int, kind string, once binary, rep binary"


def _places(hashed: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash and its PROBES bit places in it."""
    first, second = mix64(hashed), mix64(hashed ^ np.uint64(0x5BD1E995))
    block = ((first >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    step = (second >> np.uint64(20)) | np.uint64(1)
    with np.errstate(over="ignore"):
        at = (second[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None] + (first[:, None] & np.uint64(0xFFFF))) % np.uint64(BLOCK_BITS)
    return block.astype(np.int64), at.astype(np.int64)


def _pack(bits: np.ndarray) -> bytes:
    """A block's set bits as positions while they are few, else as a bit map."""
    return bits.astype("<u4").tobytes()


def _map(bits: np.ndarray) -> bytes:
    whole = np.zeros(BLOCK_BITS, bool)
    whole[bits] = True
    return np.packbits(whole, bitorder="little").tobytes()


def _bits(kind: str, raw: bytes | None) -> np.ndarray:
    whole = np.zeros(BLOCK_BITS, bool)
    if raw:
        if kind == "few":
            whole[np.frombuffer(raw, "<u4")] = True
        else:
            whole[:] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    return whole


def build(hashes: DataFrame, column: str, n: int, repeated: bool = True) -> "Filter":
    """The merged filter of a bigint column (nulls are skipped) with about n values.

    ``repeated``: the filter of hashes seen at least twice, else of all hashes.
    """
    spark = hashes.sparkSession
    blocks = int(min(MOST_BLOCKS, max(1, -(-n * BITS_PER_HASH // BLOCK_BITS))))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).drop_null().to_numpy(zero_copy_only=False) for b in batches]
        values, times = np.unique(np.concatenate(held).view(np.uint64) if held else np.empty(0, np.uint64), return_counts=True)
        if not len(values):
            return
        block, at = _places(values, blocks)
        order = np.argsort(block, kind="stable")
        block, at, twice = block[order], at[order], (times > 1)[order]
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        for s, e in zip(cut, np.append(cut[1:], len(block))):
            once, rep = np.unique(at[s:e]), np.unique(at[s:e][twice[s:e]])
            few = len(once) * 32 < BLOCK_BITS
            row = [[int(block[s])], ["few" if few else "map"], [(_pack if few else _map)(once)], [(_pack if few else _map)(rep)]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.binary()), pa.array(row[3], pa.binary())], ["block", "kind", "once", "rep"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        rep: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                k, new = row["block"], _bits(row["kind"], row["once"])
                again = _bits(row["kind"], row["rep"])
                if k in once:
                    again |= once[k] & new
                    once[k] |= new
                    rep[k] |= again
                else:
                    once[k], rep[k] = new, again
        for k in once:
            bits = np.packbits(rep[k] if repeated else once[k], bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits], pa.binary())], ["block", "bits"])

    merged = hashes.select(F.col(column).cast("long")).mapInArrow(local, _SCHEMA).repartition("block").mapInArrow(merge, "block int, bits binary")
    whole = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for row in merged.collect():  # at most MOST_BLOCKS rows of 64 KB
        whole[row.block] = np.frombuffer(row.bits, np.uint8)
    return Filter(spark.sparkContext.broadcast(whole.tobytes()), blocks)


class Filter:
    """A broadcast filter; picklable into Python tasks."""

    def __init__(self, bits, blocks: int) -> None:
        self._bits, self.blocks = bits, blocks

    def holds(self, hashed: np.ndarray) -> np.ndarray:
        """For each uint64 hash: may be in the filter."""
        if not len(hashed):
            return np.zeros(0, bool)
        raw = np.frombuffer(self._bits.value, np.uint8)
        block, at = _places(hashed, self.blocks)
        place = block[:, None] * BLOCK_BITS + at
        return ((raw[place >> 3] >> (place & 7).astype(np.uint8)) & 1).all(axis=1)
