"""SimHash near-duplicates: a self-join of binary tries that follows pairs of nodes down together.

Fingerprint: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with repeats, joined by a space
(fewer words: the whole sequence; none: zero). A bit is 1 if it is set in over half of the shingles' XXH64 (UTF-8,
seed 42). Fingerprints that differ in at most two bits are linked; a class is what links reach.

Join: two fingerprints within two bits agree on one of any three blocks of bits, and within the rest on one of any
three blocks again. So each distinct fingerprint goes under nine keys (some 35 of its bits), equal keys meet in one
task, and there the tries over the other bits are joined with themselves. Balls of near copies thin out with every
fixed bit, a group's memory is 24 bytes a distinct fingerprint, and equal texts have been merged before. No group is
capped; of the pairs that the error budget excludes only those are counted that stand below nodes with few leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import components, narrow, prepare, texts

SEED = 42
BUDGET = 2
#: Pairs of nodes followed at once in a task.
FRONTIER = 1 << 19
#: Pairs of leaves that are counted, rather than following their nodes further down.
FEW_LEAVES = 256


def fingerprint(text: str, shingle: int = 3) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts[: -shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        set_in += np.unpackbits(h[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed 64-bit number. A null text counts as empty."""

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64))

    prepare(docs.sparkSession)
    return narrow(docs, doc_id=id_col, text=text_col).select("doc_id", fp("text").alias("fp"))


def _fields() -> list[tuple[int, list[tuple[int, int]]]]:
    """For each of the nine keys: the mask of the bits that have to agree, and the fields (shift, width) of the rest."""
    blocks = [(42, 22), (21, 21), (0, 21)]
    out = []
    for shift, width in blocks:
        rest = [x for b in blocks if b[0] != shift for x in range(b[0], b[0] + b[1])]
        cut = [len(rest) * k // 3 for k in range(4)]
        for k in range(3):
            fixed = [*range(shift, shift + width), *rest[cut[k] : cut[k + 1]]]
            free = [x for x in range(64) if x not in set(fixed)]
            runs: list[tuple[int, int]] = []
            for x in free:
                if runs and runs[-1][0] + runs[-1][1] == x:
                    runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                else:
                    runs.append((x, 1))
            out.append((sum(1 << x for x in fixed), runs))
    return out


FIELDS = _fields()


def _leaf_pairs(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of leaves below pairs of trie nodes, some FRONTIER at once."""
    n2 = hi2 - lo2
    size = (hi1 - lo1) * n2
    ends = np.cumsum(size)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + FRONTIER, FRONTIER), "left").clip(0, len(size)))
    for a, z in zip(cuts, np.append(cuts[1:], len(size)), strict=True):
        if a == z:
            continue
        of = np.repeat(np.arange(a, z), size[a:z])
        within = np.arange(len(of)) - np.repeat(ends[a:z] - size[a:z] - (ends[a] - size[a]), size[a:z])
        yield lo1[of] + within // n2[of], lo2[of] + within % n2[of]


def trie_pairs(values: np.ndarray, groups: np.ndarray, width: int, budget: int, classes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i before j, of equal group and within ``budget`` bits. ``values`` are ``width`` bits, in one
    64-bit word or in a row of words, the first the highest; they are sorted and distinct within each group. A node of a
    trie is the interval of values below it. From each root with itself, pairs of nodes go down a bit at a time; a pair
    whose differing bits exceed the budget is dropped with all below it, and a pair with few leaves below is finished by
    counting the bits of these.
    With ``classes`` a pair of nodes that hold one and the same class is dropped too; the caller may merge classes in
    place between two results."""
    words = values.reshape(len(values), -1)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(groups)]
    many = ends - starts > 1
    lo, hi = starts[many], ends[many]
    stack = [(width - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int16))] if len(lo) else []
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, lo1, hi1, lo2, hi2, errors = stack.pop()
        if len(lo1) > FRONTIER:
            half = len(lo1) // 2
            stack += [(bit, *(x[s] for x in (lo1, hi1, lo2, hi2, errors))) for s in (slice(half), slice(half, None))]
            continue
        if classes is not None:
            steps = np.cumsum(np.r_[0, classes[1:] != classes[:-1]])
            mixed = (classes[lo1] != classes[lo2]) | (steps[lo1] != steps[hi1 - 1]) | (steps[lo2] != steps[hi2 - 1])
            lo1, hi1, lo2, hi2, errors = (x[mixed] for x in (lo1, hi1, lo2, hi2, errors))
        few = (hi1 - lo1) * (hi2 - lo2) <= FEW_LEAVES
        if few.any():
            for i, j in _leaf_pairs(lo1[few], hi1[few], lo2[few], hi2[few]):
                near = (i < j) & (np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int16) <= budget)
                if classes is not None:
                    near &= classes[i] != classes[j]
                if near.any():
                    yield i[near], j[near]
            lo1, hi1, lo2, hi2, errors = (x[~few] for x in (lo1, hi1, lo2, hi2, errors))
        if not len(lo1):
            continue
        if bit not in ones:
            word = words[:, words.shape[1] - 1 - (bit >> 6)]
            ones[bit] = np.concatenate(([0], np.cumsum((word >> np.uint64(bit & 63)) & np.uint64(1)))).astype(np.int64)
        c = ones[bit]
        mid1, mid2 = hi1 - (c[hi1] - c[lo1]), hi2 - (c[hi2] - c[lo2])
        same = lo1 == lo2
        parts = []
        for a, b, a2, b2, d in ((lo1, mid1, lo2, mid2, 0), (mid1, hi1, mid2, hi2, 0), (lo1, mid1, mid2, hi2, 1), (mid1, hi1, lo2, mid2, 1)):
            ok = (b > a) & (b2 > a2) & (errors + d <= budget)
            if d == 0:
                ok &= ~(same & (b - a == 1))
            elif a is mid1:
                ok &= ~same
            parts.append((a[ok], b[ok], a2[ok], b2[ok], errors[ok] + np.int16(d)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes of i[k] and j[k] for all k: ``label`` holds for each node the smallest index of its class, and
    is changed in place. The result are the k that it took, in the order of the rounds: the first pair of a class wins."""
    used, at = [], np.arange(len(i))
    while True:
        a, b = label[i[at]], label[j[at]]
        differ = a != b
        if not differ.any():
            return np.concatenate(used) if used else np.zeros(0, np.int64)
        at, low, high = at[differ], np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        upper, first = np.unique(high, return_index=True)
        used.append(at[first])
        label[upper] = low[first]
        while (label != (up := label[label])).any():
            label[:] = up


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches as arrays, cut so that no group of equal first ``keys`` columns is parted."""
    rows: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        change = np.logical_or.reduce([c != c[-1] for c in x[:keys]])
        whole = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0  # the last group may go on in the next batch
        if whole:
            yield [np.concatenate(c) for c in zip(*rows, [c[:whole] for c in x], strict=True)]
            rows = [[c[whole:] for c in x]]
        elif rows and any(a[-1] != b[0] for a, b in zip(rows[-1][:keys], x[:keys], strict=True)):
            yield [np.concatenate(c) for c in zip(*rows, strict=True)]
            rows = [x]
        else:
            rows.append(x)
    if rows:
        yield [np.concatenate(c) for c in zip(*rows, strict=True)]


def hamming_links(fps: DataFrame, budget: int = BUDGET, spanning: bool = True) -> DataFrame:
    """Links between the distinct longs of ``fps`` (column fp) at 1 to ``budget`` differing bits, budget at most 2.
    ``spanning``: (u, v) that connect the same fingerprints and are at most as many as the keys; else every linked
    pair once, as (u, v, bits)."""
    if not 0 <= budget <= 2:
        raise ValueError("three blocks find pairs of at most two differing bits")
    fields = FIELDS

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in np.unique(key):
                mask, runs = fields[k]
                own = fp[key == k].view(np.uint64)
                head, rest, width = own & np.uint64(mask), np.zeros(len(own), np.uint64), 0
                for shift, n in runs:
                    rest |= ((own >> np.uint64(shift)) & np.uint64((1 << n) - 1)) << np.uint64(width)
                    width += n
                order = np.lexsort((rest, head))
                head, rest, own = head[order], rest[order], own[order]
                pairs = trie_pairs(rest, head, width, budget)
                if spanning:
                    label = np.arange(len(own))
                    for i, j in pairs:
                        merge(label, i, j)
                    at = np.flatnonzero(label != np.arange(len(own)))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(own[at].view(np.int64)), pa.array(own[label[at]].view(np.int64))], names=["u", "v"])
                    continue
                for i, j in pairs:
                    differ = own[i] ^ own[j]
                    first = np.ones(len(i), bool)  # no earlier key has the pair
                    for earlier, _ in fields[:k]:
                        first &= (differ & np.uint64(earlier)) != 0
                    if first.any():
                        a, b = own[i[first]].view(np.int64), own[j[first]].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.bitwise_count(differ[first]).astype(np.int32))], names=["u", "v", "bits"])

        for k, _, fp in whole_groups(batches, 2):
            yield from out(k, fp)

    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("head")) for k, (m, _) in enumerate(fields)])
    rows = fps.where("fp is not null").select("fp").distinct().select("fp", F.explode(keys).alias("key")).select("key.k", "key.head", "fp")
    sorted_ = rows.repartition("k", "head").sortWithinPartitions("k", "head")
    return sorted_.mapInArrow(join, "u long, v long" if spanning else "u long, v long, bits int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id
    that links reach, itself included).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay. Null ids are
    smallest of nothing: a class of null ids only has a null component_id. An empty table gives no rows.
    """
    fp = fingerprints(docs, id_col, text_col, shingle).checkpoint()
    distinct = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(hamming_links(distinct, budget))
    by_fp = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "root")
    linked = by_fp.select(F.coalesce("root", "fp").alias("root"), "least").groupBy("root").agg(F.min("least").alias("component_id"))
    component = by_fp.select("fp", F.coalesce("root", "fp").alias("root")).join(linked, "root").select("fp", "component_id")
    return fp.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each class the document with the smallest id.
    A document is known by its id: rows that repeat a kept id stay. Rows with a null id stay if a class has null ids
    only."""
    kept = near_duplicates(docs, id_col, text_col, shingle, budget).select("component_id").distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["component_id"]), "left_semi")


__all__ = ["fingerprint", "fingerprints", "hamming_links", "near_duplicates", "one_of_each", "trie_pairs"]
