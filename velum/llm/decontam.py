"""Benchmark decontamination with suffix arrays of the training text.

Every batch of training documents is a shard. Its words become numbers (0 for words that no benchmark item has), and
its suffixes are sorted by their first ``window`` words. Each suffix of each benchmark item is then looked up with two
binary searches: the range between them holds every place where its first ``window`` words stand, and following the
words on from each place gives the longest verbatim match. Suffixes that meet a foreign word before the shortest
window ends can't match and aren't sorted, so the array is small where little is shared.

Words: A-Z in lower case, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``window`` consecutive words of an
item; an item of fewer words, but not none, is one window. The benchmark goes to the tasks in blocks of bounded size,
one pass over the documents each; nothing is dropped when it is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import fresh, keep_where, narrow, prepare, texts

WINDOW = 10
#: Pairs of a document place and an item place that are compared at once.
PAIRS = 1 << 20
#: UTF-8 bytes of benchmark text sent to the tasks at once.
BLOCK_BYTES = 16 << 20

_CASE_AND_GAPS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))

RESULT = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>,matches:array<struct<item:string,item_start:long,start:long,length:long>>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CASE_AND_GAPS).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Benchmark:
    """The test suffixes of one block of items: their distinct heads of up to ``window`` words, sorted, and whose they
    are."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.vocabulary, self.items = window, _Vocabulary(), []
        words = []
        for item, text in items:
            w = words_of(text)
            if w:
                for x in w:
                    self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
                words.append(np.array([self.vocabulary[x] for x in w], np.int32))
                self.items.append(item)
        self.flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.shortest = min((min(len(w), window) for w in words), default=window)
        heads: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for k, w in enumerate(words):
            n = min(len(w), window)
            for start in range(len(w) - n + 1):
                heads.setdefault((n, w[start : start + n].astype(">u4").tobytes()), []).append((k, start))
        self.heads = [(n, key, at) for (n, key), at in sorted(heads.items())]
        wide = f"S{4 * window}"
        self.low = np.array([key for _, key, _ in self.heads], wide)
        self.high = np.array([key.ljust(4 * window, b"\xff") for _, key, _ in self.heads], wide)

    def search(self, documents: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each document; the shard's numbers with a 0 after each document; where documents start; and pairs
        (head, place) of all occurrences."""
        counts, parts, zero = [], [], np.zeros(1, np.int32)
        number = self.vocabulary.__getitem__
        for text in documents:
            w = words_of(text)
            counts.append(len(w))
            parts += [np.fromiter(map(number, w), np.int32, len(w)), zero]
        shard = np.concatenate(parts) if parts else zero
        starts = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)[:-1])) if counts else np.zeros(0, np.int64)
        foreign = np.flatnonzero(shard == 0)  # the last word is always one
        left = np.repeat(foreign, np.diff(np.concatenate(([-1], foreign)))) - np.arange(len(shard))  # own words from here on
        suffixes = np.flatnonzero(left >= self.shortest)
        if not len(suffixes) or not self.heads:
            return counts, shard, starts, np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.concatenate((shard, np.zeros(self.window, np.int32)))
        at = suffixes[:, None] + np.arange(self.window)
        keys = padded[at].astype(">u4")
        keys[np.arange(self.window) >= left[suffixes][:, None]] = 0
        keys = np.ascontiguousarray(keys).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = hi - lo
        head = np.repeat(np.arange(len(n)), n)
        place = suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        return counts, shard, starts, head, place

    def scan(self, documents: list[str], with_matches: bool = True) -> list[dict]:
        counts, shard, starts, head, place = self.search(documents)
        out = [{"n_words": n, "spans": [], "items": [], "matches": []} for n in counts]
        if not len(head):
            return out
        doc = np.searchsorted(starts, place, "right") - 1
        length = np.array([n for n, _, _ in self.heads])[head]
        order = np.lexsort((place, doc))
        for k in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
            d = int(doc[k[0]])
            begin = place[k] - starts[d]
            out[d]["spans"] = merge_spans(zip(begin.tolist(), (begin + length[k]).tolist(), strict=True))
            found: set[int] = set()
            for h in set(head[k].tolist()):
                found.update(item for item, _ in self.heads[h][2])
            out[d]["items"] = sorted({self.items[i] for i in found})
            if with_matches:
                out[d]["matches"] = self.longest(shard, int(starts[d]), head[k], place[k])
        return out

    def longest(self, shard: np.ndarray, base: int, head: np.ndarray, place: np.ndarray) -> list[dict]:
        """Maximal verbatim matches: of each item and document place, extended as far as the words agree; one that
        only continues another is left out."""
        out = []
        for h in np.unique(head).tolist():
            n, item, start = self.owners(h)
            own = self.begins[item] + start
            at = place[head == h]
            for k in range(0, len(at), max(1, PAIRS // len(item))):
                p = at[k : k + max(1, PAIRS // len(item))]
                # a match that goes on to the left is told from there
                new = (start == 0) | (p == base)[:, None] | (self.flat[own - 1] != shard[p - 1][:, None])
                i, j = np.nonzero(new)
                length = self.common(shard, p[i], own[j], n, np.minimum(self.sizes[item[j]] - start[j], len(shard) - p[i]))
                found = zip(item[j].tolist(), start[j].tolist(), (p[i] - base).tolist(), length.tolist(), strict=True)
                out += [{"item": self.items[x], "item_start": y, "start": z, "length": size} for x, y, z, size in found]
        return sorted(out, key=lambda x: (x["start"], x["item"], x["item_start"]))


    def owners(self, h: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Words of a head, and the items and places that have it."""
        n, _, at = self.heads[h]
        item, start = np.array(at, np.int64).T
        return n, item, start

    def common(self, shard: np.ndarray, p: np.ndarray, own: np.ndarray, n: int, most: np.ndarray) -> np.ndarray:
        """How many words agree from the places p of the shard and own of the items, which do for n; at most ``most``."""
        length = np.minimum(n, most)
        going = np.flatnonzero(length < most)
        while len(going):
            going = going[self.flat[own[going] + length[going]] == shard[p[going] + length[going]]]
            length[going] += 1
            going = going[length[going] < most[going]]
        return length


def merge_spans(spans) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many blocks the distinct items make, and the blocks, which come to the driver one at a time. Null ids are ''.
    An item isn't cut: one that is larger than a block is a block of its own size."""
    b = narrow(benchmark, item=item_col, text=text_col).select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text").where("text is not null").distinct()
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    parts = (b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n))
    return n, (sorted((r.item, r.text) for r in part.collect()) for part in parts)


def _scanner(sent: Broadcast) -> Callable[..., Column]:
    @F.arrow_udf(RESULT)
    def scan_block(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(sent.value.scan(texts(batch), True), _arrow())

    return scan_block


def _merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([merge_spans((x["start"], x["end"]) for x in spans or ()) for spans in batch.to_pylist()], _arrow().field("spans").type)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: struct(n_words, spans of hit words merged, items sorted as strings,
    matches: the longest verbatim ones and where they are). Rows are taken as they are: repeated rows each get their
    result, null and empty texts have no words, an empty table stays empty. Without benchmark items nothing is hit.

    A benchmark of one block takes one pass over ``docs`` and no shuffle. A larger one takes a pass for each block, of
    which the rows with hits are kept by checkpoint(), so that there is one block in memory at a time; they are joined
    at the end.
    """
    spark = prepare(docs.sparkSession).sparkContext
    done = fresh(docs, "scanned")
    n, blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    if n == 1:
        sent = spark.broadcast(Benchmark(next(blocks), window))  # bounded by block_bytes
        return docs.withColumn(done, _scanner(sent)(F.col(text_col))), done
    row = fresh(docs, "row_of_docs")
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).checkpoint()
    words, found = None, None
    for block in blocks:
        sent = spark.broadcast(Benchmark(block, window))
        own = numbered.select(row, _scanner(sent)(F.col(text_col)).alias("s")).select(row, "s.*")
        if words is None:
            own = own.checkpoint()
            words = own.select(row, "n_words")
        own = own.where(F.size("items") > 0).drop("n_words").checkpoint()
        found = own if found is None else found.unionByName(own)
        sent.unpersist()
    together = found.groupBy(row).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "matches")])
    every = words.join(together, row, "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(together.schema[c].dataType))
    ordered = F.array_sort("matches", lambda x, y: F.when(F.struct(x["start"], x["item"], x["item_start"]) < F.struct(y["start"], y["item"], y["item_start"]), -1).otherwise(1))
    result = F.struct("n_words", F.arrow_udf(_merged, "array<struct<start:long,end:long>>")(none("spans")).alias("spans"), F.array_sort(F.array_distinct(none("items"))).alias("items"), F.coalesce(ordered, none("matches")).alias("matches"))
    return numbered.join(every.select(row, result.alias(done)), row).drop(row), done


def _arrow() -> pa.StructType:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    match = pa.list_(pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
    return pa.struct([("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string())), ("matches", match)])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 (of the
    items' ids sorted as strings and joined by commas), contaminated; and the longest verbatim match (of equal ones the
    first in the document, then by item id as a string and place in the item): longest_words, longest_start,
    longest_item, longest_item_start, null without any. Nulls, empty tables and repeats as in ``scan``."""
    found, c = scan(narrow(docs, doc_id=id_col, text=text_col), benchmark, "text", item_col, item_text_col, window, block_bytes)
    hit = F.aggregate(f"{c}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    best = F.array_max(F.transform(f"{c}.matches", lambda m: m["length"]))
    first = F.get(F.filter(f"{c}.matches", lambda m: m["length"] == best), F.lit(0))  # matches are in that order
    figures = found.select("doc_id", f"{c}.n_words", hit.alias("n_hit"), F.size(f"{c}.items").cast("long").alias("n_items"), F.sha2(F.array_join(f"{c}.items", ","), 256).alias("items_sha256"), first.alias("m"))
    return figures.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), F.col("m.length").alias("longest_words"), F.col("m.start").alias("longest_start"), F.col("m.item").alias("longest_item"), F.col("m.item_start").alias("longest_item_start"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim matches and where they are: doc_id, item, item_start, start, length (in words)."""
    found, c = scan(narrow(docs, doc_id=id_col, text=text_col), benchmark, "text", item_col, item_text_col, window, block_bytes)
    return found.select("doc_id", F.inline(f"{c}.matches"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs. Null and empty texts stay, repeated rows
    have one fate, an empty table gives none."""
    found, c = scan(docs, benchmark, text_col, item_col, item_text_col, window, block_bytes)
    return keep_where(found, F.size(f"{c}.spans") == 0).drop(c)
