"""Which of millions of literals occur in which texts, as a join.

No task holds the literals: of every window of a text that is as long as one of them, a filter of bounded size (Bloom's)
says whether it may be one, and only those that may meet the literals, by a hash of 64 bits. So a text is read once,
however many literals there are. What is found is a little more than what occurs, never less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.operators.pieces import fold

#: Characters of a literal, at most: so many lengths of windows there can be.
LONGEST = 32
#: Bits of the filter for each literal, at least, and in all (128 MB), at most; with fewer more windows pass.
BITS, MOST_BITS = 24, 1 << 30
#: Bits of a part of the filter, which one task makes; a literal's bits are in one part.
_PART = 20
_HASHES = 4
#: Places that are looked at together, so that their hashes stay in a core's cache.
_TOGETHER = 1 << 15
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def folded(text: str) -> str:
    """As Java folds characters where case doesn't count: the capital I with a dot is an i too."""
    return fold(text).replace("İ", "i")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with a zero after each, and where each begins; zeros enough for a window are behind."""
    codes = np.frombuffer(("\0".join(texts) + "\0" * (LONGEST + 1)).encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=starts[1:])
    return codes, starts


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ h >> np.uint64(29)


def hashes(literals: list[str]) -> np.ndarray:
    """A hash of each, as longs: that of an equal window."""
    if not literals:
        return np.zeros(0, np.int64)
    codes, starts = _codes(literals)
    lengths = np.fromiter(map(len, literals), np.int64, len(literals))
    h = np.ones(len(literals), np.uint64)  # not zeros, so that zeros in front count
    for k in range(lengths.max()):
        on = np.flatnonzero(lengths > k)
        h[on] = h[on] * _BASE + codes[starts[on] + k]
    return _mixed(h).view(np.int64)


def _bits_of(h: np.ndarray) -> Iterator[np.ndarray]:
    """Places of a hash in its part."""
    mask = np.uint64((1 << _PART) - 1)
    at, step = h & mask, h >> np.uint64(_PART) & mask | np.uint64(1)
    for _ in range(_HASHES):
        yield at
        at = at + step & mask


@dataclass(frozen=True)
class Filter:
    """The bits, what lengths literals have, and whether one begins with a character (by its last 16 bits)."""

    bits: np.ndarray
    parts: int  # the power of two
    lengths: tuple[int, ...]
    firsts: np.ndarray

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may be a literal's."""
        live = np.arange(len(h))
        own = h >> np.uint64(64 - self.parts) << np.uint64(_PART)
        for k, at in enumerate(_bits_of(h)):
            place = own[live] | (at if k == 0 else at[live])
            live = live[(self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
            if not len(live):
                break
        return live

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of (folded) texts and hashes of windows that may be literals."""
        own, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        if texts:
            codes, starts = _codes(texts)
            every = np.flatnonzero(self.firsts[codes & np.uint32(0xFFFF)])
            for k in range(0, len(every), _TOGETHER):
                places = every[k : k + _TOGETHER]
                places = places[places <= len(codes) - LONGEST]
                h = np.ones(len(places), np.uint64)
                for n in range(1, self.lengths[-1] + 1):
                    h = h * _BASE + codes[places + (n - 1)]
                    if n in self.lengths:
                        mixed = _mixed(h)
                        live = self.passes(mixed)
                        own.append(np.searchsorted(starts, places[live], "right") - 1)
                        out.append(mixed[live])
        return np.concatenate(own), np.concatenate(out)


def filter_of(literals: DataFrame) -> Filter | None:
    """The filter of the literals (x: string, h: its hash); None if there are none. Its parts are made by tasks, the
    driver gets them and no literal."""
    (r,) = literals.agg(F.approx_count_distinct("h").alias("many"), F.collect_set(F.length("x")).alias("lengths"), F.collect_set(F.ascii("x") % 65536).alias("firsts")).collect()
    if not r.many:
        return None
    size = min(1 << max(_PART + 1, (BITS * r.many - 1).bit_length()), MOST_BITS)
    parts = size.bit_length() - 1 - _PART

    def made(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _PART, bool)
        for at in _bits_of(group["h"].to_numpy().view(np.uint64)):
            bits[at] = True
        return pa.table({"part": pa.array([group["part"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    by_part = literals.select("h").distinct().withColumn("part", F.shiftrightunsigned("h", 64 - parts).cast("int")).groupBy("part").applyInArrow(made, "part int, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for p in by_part.toLocalIterator():
        bits[p.part << _PART - 3 : p.part + 1 << _PART - 3] = np.frombuffer(p.bits, np.uint8)
    firsts = np.zeros(1 << 16, bool)
    firsts[r.firsts] = True
    return Filter(bits, parts, tuple(sorted(r.lengths)), firsts)


def windows(texts: DataFrame, sent: Broadcast) -> DataFrame:
    """(key, h) of ``texts`` (key: long, text: string): hashes of windows that may be literals, once a batch and key."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            keys = batch.column(0).to_numpy()
            own, found = known.found([folded(t) for t in batch.column(1).to_pylist()])
            key, h = keys[own], found.view(np.int64)
            order = np.lexsort((h, key))
            key, h = key[order], h[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(key[new], pa.int64()), pa.array(h[new], pa.int64())], names=["key", "h"])

    return texts.mapInArrow(find, "key long, h long")


def hashed(literals: list[list[str]]) -> pa.Array:
    """Lists of literals as lists of struct<x, h>."""
    flat = [x for own in literals for x in own]
    ends = np.cumsum([0, *map(len, literals)])
    pairs = pa.StructArray.from_arrays([pa.array(flat, pa.string()), pa.array(hashes(flat), pa.int64())], ["x", "h"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


HASHED = "array<struct<x:string,h:long>>"


def key_of(text: Column) -> Column:
    """What stands for a text of a partition, so that no more rows than a partition has share one however often a text
    is repeated. Texts that share one get each other's candidates too. Partitions must not change between two uses."""
    return F.xxhash64(text, F.spark_partition_id())


__all__ = ["HASHED", "LONGEST", "Filter", "filter_of", "folded", "hashed", "hashes", "key_of", "windows"]
