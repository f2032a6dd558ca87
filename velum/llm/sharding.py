"""Shards of near equal bytes by histogram sort.

Key of a row: (hash of its text, its id), so that equal texts are neighbours and only a boundary can part them. For
each splitter an interval of keys is known that holds its target. In every round, probes are put into the intervals
that are still too wide; every partition counts the exact bytes and rows between probes, and notes the smallest and
largest key there, which closes in on the keys that exist (a text that holds a third of all rows soon is an interval
of its own, parted by id). When all splitters meet their tolerance, the rows are exchanged once, by the range they fall
into; a row's slot is the exact number of rows in earlier ranges of its shard plus its place in its range.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import fresh, prepare

SHARDS = 8
#: How far a shard's boundary may be from its target, as a share of a shard's bytes.
TOLERANCE = 0.0005
#: Probes for each splitter in a round.
PROBES = 16
#: Bytes of text in a range, of which each is one task's, and how many ranges there are at most: above that they grow.
RANGE_BYTES, RANGES = 16 << 20, 1 << 14
#: A range within a shard may be larger by this share of a range than it should be.
RANGE_TOLERANCE = 0.5

_KEYS = 1 << 128


def _keys(hi: pa.Array, lo: pa.Array) -> np.ndarray:
    """Sixteen bytes a row that sort as (hi, lo). A null lo comes first."""
    parts = [np.asarray(x.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), np.int64).view(np.uint64) ^ np.uint64(1 << 63) for x in (hi, lo)]
    return np.stack(parts, axis=1).astype(">u8").view("S16").ravel()


def _bytes(probes: list[int]) -> np.ndarray:
    return np.array([p.to_bytes(16, "big") if p < _KEYS else b"\xff" * 17 for p in probes], "S17")


def _count(keys: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(range, bytes, rows, smallest key, largest key) of each range between probes that has rows."""
    sent = keys.sparkSession.sparkContext.broadcast(_bytes(probes))  # as many as the splitters allow

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            k = _keys(b.column(0), b.column(1))
            order = np.argsort(k, kind="stable")
            k, size = k[order], b.column(2).to_numpy()[order]
            at = np.searchsorted(sent.value, k, "right")
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(k) else []
            for a, z in zip(cut, [*cut[1:], len(k)], strict=True):
                own = (int(size[a:z].sum()), int(z - a), bytes(k[a]).ljust(16, b"\0"), bytes(k[z - 1]).ljust(16, b"\0"))
                old = found.get(int(at[a]))
                found[int(at[a])] = list(own) if old is None else [old[0] + own[0], old[1] + own[1], min(old[2], own[2]), max(old[3], own[3])]
        rows = sorted((k, *v) for k, v in found.items())
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["range", "bytes", "rows", "least", "most"])

    counted = keys.mapInArrow(count, "range int, bytes long, rows long, least binary, most binary")
    total = counted.groupBy("range").agg(F.sum("bytes"), F.sum("rows"), F.min("least"), F.max("most")).collect()
    return sorted((r[0], r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in total)


def splitters(keys: DataFrame, shards: int, per_shard: int, tolerance: float = TOLERANCE, probes: int = PROBES, max_rounds: int = 200) -> list[tuple[int, int, int]]:
    """``shards * per_shard - 1`` boundaries (key, bytes below, rows below) of ``keys`` (hi, lo, size)."""
    n = shards * per_shard
    known: dict[int, tuple[int, int]] = {0: (0, 0)}  # key -> exact bytes and rows below it
    ask = sorted({_KEYS * k // (4 * n) for k in range(1, 4 * n)})
    total = None
    for _ in range(max_rounds):
        below = rows = 0
        counts = {r[0]: r[1:] for r in _count(keys, ask)}
        for k in range(len(ask) + 1):
            known[ask[k - 1] if k else 0] = (below, rows)
            if k in counts:
                size, m, least, most = counts[k]
                known[least] = (below, rows)
                below, rows = below + size, rows + m
                known[most + 1] = (below, rows)
        if total is None:
            total = (below, rows)
            known[_KEYS] = total
        places = sorted(known)
        lows = [known[p][0] for p in places]
        out, ask_next = [], set()
        for k in range(1, n):
            target = total[0] * k // n
            allowed = tolerance * total[0] / shards if k % per_shard == 0 else RANGE_TOLERANCE * total[0] / n
            i = bisect.bisect_right(lows, target) - 1
            lo = places[i]
            hi = places[min(i + 1, len(places) - 1)]
            best = min((lo, hi), key=lambda p: abs(known[p][0] - target))
            out.append((best, *known[best]))
            if abs(known[best][0] - target) > allowed and hi - lo > 1 and known[hi][1] - known[lo][1] > 1:
                ask_next |= {lo + (hi - lo) * j // (probes + 1) for j in range(1, probes + 1)} | {hi}
                ask_next.discard(lo)
        if not ask_next:
            return out
        ask = sorted(ask_next)
    raise RuntimeError("the splitters did not settle")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``docs``, all columns, with size (UTF-8 bytes of the text, null none, plus 1), shard (0 to shards - 1, of near
    equal size) and slot (gapless from 0 in each shard, in the order of the keys). Columns of ``docs`` with one of
    these names are replaced.

    Rows that share both text and id have one key and stay together. Null ids come first among equal texts. With fewer
    rows than shards some are empty; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("size", "shard", "slot")
    hi, lo, place = fresh(docs, "key_hi"), fresh(docs, "key_lo"), fresh(docs, "range_of_keys")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"size": F.octet_length(text).cast("long") + 1, hi: F.xxhash64(text), lo: F.col(id_col).cast("long")})
    keys = keyed.select(F.col(hi).alias("hi"), F.col(lo).alias("lo"), "size").checkpoint()
    total = keys.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, min(-(-total // (RANGE_BYTES * shards)), RANGES // shards))
    bounds = splitters(keys, shards, per_shard, tolerance)
    edges = _bytes([b[0] for b in bounds])
    rows_below = np.array([0, *(b[2] for b in bounds)], np.int64)
    sent = spark.sparkContext.broadcast((edges, rows_below))  # one entry a range

    def locate(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        edges, below = sent.value
        for h, i in batches:
            at = np.searchsorted(edges, _keys(h, i), "right")
            own = at // per_shard
            yield pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(below[at] - below[own * per_shard])], names=["range", "shard", "base"])

    located = keyed.withColumn(place, F.arrow_udf(locate, "struct<range:int,shard:int,base:long>")(F.col(hi), F.col(lo)))
    ranged = located.repartitionById(per_shard * shards, F.col(f"{place}.range"))  # a range is a partition
    ranged = ranged.sortWithinPartitions(hi, F.col(lo).asc_nulls_first())
    slot = F.col(f"{place}.base") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's number in its partition
    return ranged.withColumns({"shard": F.col(f"{place}.shard"), "slot": slot}).drop(hi, lo, place)


def write_shards(docs: DataFrame, path: str, **options: object) -> None:
    """Write the shards as Parquet, one folder a shard; rows as in ``shard``. An empty table writes no shard."""
    shard(docs, **options).write.partitionBy("shard").mode("errorifexists").parquet(path)
