"""Near duplicates by similarity: texts whose sets of five-word shingles have a Jaccard index of 0.8 or more are
linked, a class is what links reach. SimHash tries find the pairs, the exact index decides.

Words as for fingerprints (``simhash``); fewer than five are one shingle; no word, the empty set. Equal texts are one
node. Its fingerprint has 256 bits, each set by over half of the distinct shingles: at an index of J two fingerprints
differ in a share of arccos(2J / (1 + J)) / pi of their bits, 0.152 at 0.8. An error budget that wide prunes nothing near
the root, so that one trie of all nodes would mean all pairs. Hence there are ROUTES smaller tries for each node: that of
the nodes with the same sample, the three shingles that are least in an order of the route's own. Sets at 0.8 draw the
same sample with probability 0.8^3 in each route, and in one of them with 0.9998; unrelated texts hardly ever do.

A passage or a family that many texts share still makes large tries. One of over 2^ROOM nodes is joined subtree by
subtree at such a level that some 2^ROOM unrelated nodes are in each, several times over, with the bits in other orders,
until a pair at 0.8 meets with probability RECALL. So work grows with the nodes, not with their square.

Step 1: each trie is joined with itself under rising budgets, the nearest first, and only pairs that connect two parts
are kept: fewer than nodes, whatever the size of a family of copies. The exact index confirms them. Step 2: again, where
classes still differ. Nodes that can't have a link (to another class) are left out, before step 2 and from large tries, by
counting: with the shingles of each set in one order, two sets of sizes a <= b at 0.8 or more share one of the first a - 8a/9 + 1 of the one and the first
b - 0.8b + 1 of the other (rounded up), and in the order of rarity these are what a text doesn't share with its family. So
texts made from one template, near to each other in bits and below 0.8, leave here and are never compared in pairs. A
pair of trie nodes below which there is one class only is dropped, so that families that are connected cost nothing. The
nodes that are near to another class are sent to their tries with their texts, and the exact index is taken there, so
that the links come out and not the pairs; of tries with more than GROUP_TEXT characters only the fingerprints are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import components, fresh, narrow, prepare, shuffles_dropped, texts
from velum.llm.simhash import merge, trie_pairs, whole_groups

SHINGLE = 5
LEAST = 0.8
#: 64-bit words of a fingerprint.
WORDS = 4
#: Samples of a text, and the shingles in each.
ROUTES, DRAWN = 12, 3
#: Unrelated nodes in a subtree, as a power of two, and the share of pairs at LEAST that meet in one of a large trie's.
ROOM, RECALL = 10, 0.999
LEAST_RATIO = Fraction(LEAST).limit_denominator(1000).as_integer_ratio()
_DIFFER = math.acos(2 * LEAST / (1 + LEAST)) / math.pi
#: Differing bits at LEAST, and 3.3 times their deviation.
BUDGET = int(64 * WORDS * _DIFFER + 3.3 * math.sqrt(64 * WORDS * _DIFFER * (1 - _DIFFER)))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 13
#: Shingles of texts met before that a task keeps.
_HELD = 1 << 21
#: Keys that are sent to all tasks, 8 bytes each; more are joined by a shuffle.
_SENT_KEYS = 2_000_000
#: Characters of a trie's texts up to which they are sent to its task; the pairs of larger ones are confirmed by a join.
GROUP_TEXT = 64 << 20
#: Counters of shingles, as a power of two, and how often a task has to meet one to tell. They decide the order of
#: shingles only, any of which gives the same links.
_COUNTERS, _TELL = 22, 8
_RANDOM = np.random.default_rng(5)
_XOR = _RANDOM.integers(0, 1 << 64, ROUTES * DRAWN, np.uint64)[:, None]
_FACTOR = _RANDOM.integers(0, 1 << 64, ROUTES * DRAWN, np.uint64)[:, None] | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the shingles, ascending. Each is made of its words' hashes, in their order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    each = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    made = np.full(n, size, np.uint64)
    for k in range(size):
        made = (made ^ each[k : k + n]) * _ODD
        made ^= made >> np.uint64(29)
    return np.unique(made)


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """WORDS words: a bit is 1 if it is set in over half of the hashes derived from ``own``."""
    set_in = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(own), 255):  # so many fit a byte
        mixed = own[k : k + 255, None] + np.arange(WORDS, dtype=np.uint64) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
        mixed ^= mixed >> np.uint64(29)
        set_in += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(set_in * 2 > len(own)).view(np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def samples(own: np.ndarray) -> list[int]:
    """For each route a hash of the shingles that it draws: the least by each of DRAWN orders."""
    least = np.full(ROUTES * DRAWN, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), _CHUNK):
        least = np.minimum(least, ((own[None, k : k + _CHUNK] ^ _XOR) * _FACTOR).min(axis=1))
    raw, width = least.tobytes(), 8 * DRAWN
    return [xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) - (1 << 63) for k in range(ROUTES)]


def orders(level: int) -> np.ndarray:
    """For each order of the bits the mask of those that lead to its subtrees at ``level``, as a row of words. As many
    as a pair at LEAST needs to meet with probability RECALL."""
    meet = (1 - _DIFFER) ** level
    count = 1 if level == 0 else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))
    rng, masks = np.random.default_rng(level), np.zeros((count, WORDS), np.uint64)
    for mask in masks:
        for bit in rng.choice(64 * WORDS, level, replace=False).tolist():
            mask[bit >> 6] |= np.uint64(1 << (bit & 63))
    return masks


_FP = [f"f{k}" for k in range(WORDS)]


def _fingerprints(d: DataFrame) -> DataFrame:
    """Rows (doc_id, key, f0, ..., heads): the text's hash, fingerprint and samples."""
    kind = pa.struct([*[(f, pa.int64()) for f in _FP], ("heads", pa.list_(pa.int64()))])

    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, batch in batches:
            known: dict[int, tuple[np.ndarray, list[int]]] = {}
            rows = []
            for key, t in zip(keys.to_pylist(), texts(batch), strict=True):
                if key not in known:
                    own = shingles(t)
                    known[key] = wide_fingerprint(own), samples(own)
                rows.append(known[key])
            columns = np.array([fp for fp, _ in rows], np.uint64).reshape(-1, WORDS).view(np.int64).T
            yield pa.StructArray.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array([h for _, h in rows], pa.list_(pa.int64()))], fields=list(kind))

    made = F.arrow_udf(read, "struct<" + ",".join(f"{f}:long" for f in _FP) + ",heads:array<long>>")
    return d.select("doc_id", "key", made("key", "text").alias("s")).select("doc_id", "key", "s.*")


def _sent(keys: DataFrame) -> DataFrame:
    """``keys``, a checkpoint, to be joined: sent to all tasks where they are few enough, so that what they are joined with
    isn't shuffled."""
    return F.broadcast(keys) if keys.count() <= _SENT_KEYS else keys


def _frequencies(texts_: DataFrame) -> np.ndarray:
    """For each counter the logarithm of how often its shingles are in ``texts_`` (rows with text), roughly. A task tells
    of the counters that it has met often; the driver holds one number a counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(1 << _COUNTERS, np.int32)
        for batch in batches:
            for t in texts(batch.column(0)):
                met[shingles(t) >> np.uint64(64 - _COUNTERS)] += 1
        at = np.flatnonzero(met >= _TELL)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(met[at].astype(np.int64))], names=["counter", "n"])

    told = texts_.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << _COUNTERS, np.uint8)
    out[told.column("counter").to_numpy()] = np.minimum(255, 8 * np.log2(told.column("n").to_numpy() + 1)).astype(np.uint8)
    return out


def leading(own: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the order of rarity, of which a set at LEAST or more that isn't smaller has one among
    the first ``n`` here, and a smaller one has one of its own first ``n`` among all that are given; and that n."""
    order = np.lexsort((own, often[own >> np.uint64(64 - _COUNTERS)]))
    size, (up, low) = len(own), LEAST_RATIO
    both = -(-2 * up * size // (up + low))  # shared with a set of the same size, or a larger one
    return own[order[: size - -(-up * size // low) + 1]], size - both + 1


def _possible(classed: DataFrame) -> DataFrame:
    """The keys of ``classed`` (key, class, text; equal rows may repeat) that may have a link to another class: those with a
    leading shingle that another class has too, and that is among the first ones of at least one of both."""
    sent = classed.sparkSession.sparkContext.broadcast(_frequencies(classed))  # one byte a counter

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # equal texts are told once a task
        for batch in batches:
            every = batch.column(0).to_pylist()
            new = [k for k, key in enumerate(every) if key not in told and not told.add(key)]
            if not new:
                continue
            batch = batch.take(pa.array(new))
            keys, groups = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = [leading(shingles(t), sent.value) for t in texts(batch.column(2))]
            sizes = [len(x) for x, _ in found]
            first = np.concatenate([np.arange(len(x)) < n for x, n in found])
            columns = [np.concatenate([x for x, _ in found]).view(np.int64), np.repeat(keys, sizes), np.repeat(groups, sizes), first]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "key", "class", "first"])

    rows = classed.select("key", "class", "text").mapInArrow(lead, "shingle long, key long, class long, first boolean")
    own = F.when(F.col("first"), F.col("class"))
    shared = rows.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min(own).alias("first_low"), F.max(own).alias("first_high"))
    shared = _sent(shared.where("low < high and first_low is not null").select("shingle", "first_low", "first_high").checkpoint())
    met = F.col("first") | (F.col("first_low") != F.col("class")) | (F.col("first_high") != F.col("class"))
    return rows.join(shared, "shingle").where(met).select("key").distinct()


def _tries(d: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` once a trie (column trie) or subtree (column head) of two or more. Of tries with over 2^ROOM nodes those
    that can't have a link are left out."""
    rows = nodes.select(F.explode("heads").alias("trie"), "key", *_FP)
    sizes = _sizes(rows)
    large = sizes.where("level > 0").select("trie").checkpoint()
    if not large.isEmpty():
        large = _sent(large)
        met = _sent(rows.join(large, "trie", "left_semi").select("key").distinct().checkpoint())
        possible = _sent(_possible(d.select("key", F.col("key").alias("class"), "text").join(met, "key", "left_semi").select("key", "class", "text")).checkpoint())
        rows = rows.join(large, "trie", "left_anti").unionByName(rows.join(large, "trie", "left_semi").join(possible, "key", "left_semi"))
        sizes = _sizes(rows)
    deepest = sizes.agg(F.max("level")).first()[0] or 0
    ways = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), *[F.lit(int(m)).alias(f"m{k}") for k, m in enumerate(row)]) for t, row in enumerate(orders(level).view(np.int64))]) for level in range(deepest + 1)])
    met = rows.join(sizes, "trie").select("*", F.explode(ways[F.col("level").cast("int")]).alias("m"))
    below = F.xxhash64("trie", "m.t", *[F.col(f).bitwiseAND(F.col(f"m.m{k}")) for k, f in enumerate(_FP)])
    return met.select(F.when(F.col("level") == 0, F.col("trie")).otherwise(below).alias("head"), "trie", "key", *_FP)


def _sizes(rows: DataFrame) -> DataFrame:
    """(trie, level) of the tries with two nodes or more; a level says at which depth subtrees have some 2^ROOM."""
    return rows.groupBy("trie").count().where("count > 1").withColumn("level", F.greatest(F.ceil(F.log2("count")) - ROOM, F.lit(0))).drop("count").checkpoint()


def _by_head(rows: DataFrame) -> DataFrame:
    """Members of a subtree together and sorted."""
    return rows.repartition("head").sortWithinPartitions("head")


class _Group:
    """Nodes of some tries, sorted. Of equal fingerprints one (``first``) goes into the trie, the others hang on it."""

    def __init__(self, head: np.ndarray, fp: list[np.ndarray]):
        values = np.stack(fp, axis=1).view(np.uint64)
        self.order = np.lexsort((*reversed([values[:, k] for k in range(WORDS)]), head))
        head, values = head[self.order], values[self.order]
        equal = np.r_[False, (head[1:] == head[:-1]) & (values[1:] == values[:-1]).all(axis=1)]
        self.first = np.flatnonzero(~equal)
        self.hang, self.on = np.flatnonzero(equal), self.first[np.cumsum(~equal) - 1][equal]
        self.values, self.head = values[self.first], head[self.first]

    def near(self, budget: int, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in ``first`` within ``budget`` bits, nearest first."""
        for i, j in trie_pairs(self.values, self.head, 64 * WORDS, budget, classes):
            at = np.argsort(np.bitwise_count(self.values[i] ^ self.values[j]).sum(axis=1), kind="stable")
            yield i[at], j[at]


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (head, trie, key, f0, ...): pairs (u, v) within BUDGET bits that connect the same nodes as all such pairs,
    the nearest."""
    for head, _, key, *fp in whole_groups(batches):
        g = _Group(head, fp)
        key = key[g.order]
        if len(g.hang):
            yield _pairs(key[g.on], key[g.hang])
        label = np.arange(len(g.first))
        for budget in (2 * WORDS, 6 * WORDS, BUDGET):
            for i, j in g.near(budget, label):
                used = merge(label, i, j)
                if len(used):
                    yield _pairs(key[g.first[i[used]]], key[g.first[j[used]]])


def _unsettled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (head, trie, key, f0, ..., class): the (head, trie, key) that are within BUDGET bits of another class."""
    for head, trie, key, *fp, group in whole_groups(batches):
        g = _Group(head, fp)
        group = group[g.order]
        marked = np.zeros(len(key), bool)
        apart = group[g.on] != group[g.hang]
        marked[g.on[apart]] = marked[g.hang[apart]] = True
        known = np.unique(group[g.first], return_inverse=True)[1]
        for i, j in trie_pairs(g.values, g.head, 64 * WORDS, BUDGET, known):
            new = known[i] != known[j]
            marked[g.first[i[new]]] = True
            marked[g.first[j[new]]] = True
        # what hangs on a marked node is near to the same ones
        marked[g.hang] |= marked[g.on]
        at = g.order[marked]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(head[at]), pa.array(trie[at]), pa.array(key[at])], names=["head", "trie", "key"])


def _settler(with_texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (head, trie, key, class, f0, ..., heads, text), sorted by head: pairs (u, v, sure) of different classes,
    confirmed by the exact index and fewer than classes; without texts all pairs within BUDGET bits, not sure. A pair is
    tested in the first trie that both are in."""

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, trie, key, group, *fp, heads, text in whole_groups(batches):
            g = _Group(head, fp)
            trie, key, group, text = trie[g.order], key[g.order], group[g.order], text[g.order]
            every = np.stack(heads[g.order].tolist())
            start, place = np.unique(group, return_index=True, return_inverse=True)[1:]
            label = start[place]
            own: dict[int, np.ndarray] = {}

            def of(k: int, own: dict = own, text: np.ndarray = text) -> np.ndarray:
                if k not in own:
                    own[k] = shingles(text[k])
                return own[k]

            def tested(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
                for k in range(0, len(i), 1 << 14):
                    a, b = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    shared = every[a] == every[b]
                    new = (every[a, shared.argmax(axis=1)] == trie[a]) & (label[a] != label[b])
                    a, b = a[new], b[new]
                    if not with_texts:
                        if len(a):
                            yield _pairs(key[a], key[b], False)
                        continue
                    found = []
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        if label[x] != label[y] and jaccard(of(x), of(y)) >= LEAST:
                            merge(label, np.array([x]), np.array([y]))
                            found.append((x, y))
                    if found:
                        x, y = np.array(found).T
                        yield _pairs(key[x], key[y], True)

            yield from tested(g.on, g.hang)
            known = label[g.first]
            for i, j in g.near(BUDGET, known):
                yield from tested(g.first[i], g.first[j])
                known[:] = label[g.first]

    return settled


def _pairs(u: np.ndarray, v: np.ndarray, *sure: bool) -> pa.RecordBatch:
    columns = [pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), *[pa.array(np.full(len(u), x)) for x in sure]]
    return pa.RecordBatch.from_arrays(columns, names=["u", "v", "sure"][: len(columns)])


def _texts(d: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (key, text) of the ``wanted`` keys. Where these are few enough to send, the other texts aren't shuffled."""
    few = wanted.count() <= _SENT_KEYS
    return d.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))


def _linked(once: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose exact index is LEAST or more. ``once``: rows (key, text)."""

    @F.arrow_udf("boolean")
    def near(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[str, np.ndarray] = {}
        room = _HELD

        def of(text: str) -> np.ndarray:
            nonlocal room
            own = known.get(text)
            if own is None:
                own = shingles(text)
                room -= len(own) + len(text) // 4
                if room < 0:
                    known.clear()
                    room = _HELD
                known[text] = own
            return own

        for left, right in batches:
            yield pa.array([jaccard(of(a), of(b)) >= LEAST for a, b in zip(texts(left), texts(right), strict=True)], pa.bool_())

    both = pairs.join(once.select(F.col("key").alias("u"), F.col("text").alias("a")), "u").join(once.select(F.col("key").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", near("a", "b").alias("near")).where("near").select("u", "v")


def links(d: DataFrame, nodes: DataFrame, group_text: int = GROUP_TEXT) -> DataFrame:
    """Pairs (u, v) of keys at LEAST or more that connect all that such pairs connect. ``d`` has rows (key, text),
    ``nodes`` rows (key, f0, ..., heads), each key once."""
    members = _tries(d, nodes).checkpoint()
    pairs = _by_head(members).mapInArrow(_spanning, "u long, v long").distinct().checkpoint()
    # a node that is near to any other in a trie is in one of these pairs, so that no other text is needed later
    once = _texts(d, pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct().checkpoint()).checkpoint()
    first = _linked(once, pairs).checkpoint()
    roots = components(first).checkpoint()
    classed = lambda rows: rows.join(roots, rows["key"] == roots["node"], "left").withColumn("class", F.coalesce("root", "key")).drop("node", "root")
    contested = classed(members).groupBy("head").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("head").checkpoint()
    met = _sent(members.join(_sent(contested), "head", "left_semi").select("key").distinct().checkpoint())
    possible = _sent(_possible(classed(once.join(met, "key", "left_semi")).select("key", "class", "text")).checkpoint())
    rest = classed(members.join(possible, "key", "left_semi")).select(*members.columns, "class")
    unsettled = _by_head(rest).mapInArrow(_unsettled, "head long, trie long, key long").checkpoint()
    sizes = unsettled.join(once.select("key", F.char_length("text").alias("n")), "key").groupBy("head").agg(F.sum("n").alias("n"))
    large = sizes.where(F.col("n") > group_text).select("head").checkpoint()
    with_class = classed(unsettled.join(nodes, "key"))
    columns = ["head", "trie", "key", "class", *_FP, "heads", "text"]
    settle = lambda rows, with_texts: _by_head(rows.select(*columns)).mapInArrow(_settler(with_texts), "u long, v long, sure boolean")
    second = settle(with_class.join(large, "head", "left_anti").join(once, "key"), True)
    if not large.isEmpty():
        second = second.unionAll(settle(with_class.join(large, "head", "left_semi").withColumn("text", F.lit(None).cast("string")), False))
    second = second.distinct().checkpoint()
    found = first.unionAll(second.where("sure").select("u", "v"))
    unsure = second.where("not sure").select("u", "v")
    return found if unsure.isEmpty() else found.unionAll(_linked(once, unsure))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the smallest doc_id that links reach, itself included).

    Null texts count as empty ones; texts without words are all alike. Repeated rows stay. Null ids are smallest of
    nothing: a class of null ids only has a null component_id. An empty table gives no rows. Texts are told apart by a
    64-bit hash.
    """
    spark = prepare(docs.sparkSession)
    d = narrow(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.xxhash64("text"))
    with shuffles_dropped(spark):
        rows = _fingerprints(d).checkpoint()
        nodes = rows.groupBy("key").agg(F.min("doc_id").alias("least"), *[F.first(f).alias(f) for f in (*_FP, "heads")]).checkpoint()
        roots = components(links(d, nodes.drop("least")))
    by_key = nodes.join(roots, nodes["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    component = by_key.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "key").join(by_key.join(component, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each class the document with the smallest id.
    A document is known by its id: rows that repeat a kept id stay. Rows with a null id stay if a class has null ids
    only. Null and empty texts, repeats and empty tables as in ``near_duplicates``."""
    c = fresh(docs, "least_id")
    kept = near_duplicates(docs, id_col, text_col).select(F.col("component_id").alias(c)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[c]), "left_semi")


__all__ = ["jaccard", "links", "near_duplicates", "one_of_each", "orders", "samples", "shingles", "wide_fingerprint"]
