"""Prefix trie of conversations, without following links: owners by binary search, sums by chains.

A node is a distinct sequence of first turns; its conversations are those that begin with it, and it is owned by the one
with the smallest id. Whoever owns a prefix owns all its longer ones, so the nodes that a conversation owns are a chain
that reaches to its end, and the first owned depth is found by binary search: every round joins one prefix digest of each
conversation with the minima, one row a distinct prefix, all conversations at once. The last prefix that another one owned
names the parent, so owned chains form a tree. Its sums go bottom-up by doubling: after k rounds a chain has what hangs
within 2^k chains below it. Inside a chain they are running totals.

A prefix is known by its depth and two 64-bit numbers, the xor of the hashes of (depth, turn) over its turns. Turns are
numbered and prefixes made by totals over blocks (``velum.functions.ranges``), digests are kept in rows of BLOCK, and
conversations of more are searched by rows first: no task needs a whole conversation, and no row grows with one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.ranges import along, running
from velum.llm.common import narrow, prepare

#: Prefixes in a row while searching.
BLOCK = 64
#: Turns in a block of running totals, as a power of two.
_CUT = 12
#: Ids that share a row when a node's ends are joined to one text, as a power of two.
_IDS = 16
_PREFIX = ["depth", "x1", "x2"]


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, position, a, b, chars), positions from 1 in order of turn, null first, of equal ones by their hashes.
    Null roles and texts are empty. Rows without a conversation's id belong to none and are left out."""
    d = narrow(conversations, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id is not null")
    d = d.withColumns({"conv_id": F.col("conv_id").cast("long"), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    short = d.select("conv_id", "turn", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role").alias("b"), F.char_length("text").cast("long").alias("chars"))
    return running(short, ["conv_id"], ["turn", "a", "b"], {"position": (F.sum, F.lit(1))}).drop("turn")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Each conversation c, begun anew by its group: the first h turns of conversation c - c % ``group`` (as many as there
    are), then its own after its first h; h is the CRC-32 of c in decimal, modulo ``most``. Rows (conv_id, depth, a, b,
    chars) of the turns, depth from 1, and rows (conv_id, turns) of all conversations, turnless ones too."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("position") < most))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("position", "a", "b", "chars"))).alias("head"))
    sizes = turns.groupBy("conv_id").agg(F.max("position").alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    begun = sizes.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    begun = begun.select("conv_id", "head", (F.size("head") - F.col("h")).alias("shift"), (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")).checkpoint()
    taken = begun.select("conv_id", F.inline("head")).withColumnRenamed("position", "depth")
    moved = begun.where("shift <> 0").select("conv_id", "shift")  # those whose first conversation is too short
    own = turns.where(F.col("position") > h).join(moved, "conv_id", "left")
    own = own.select("conv_id", (F.col("position") + F.coalesce("shift", F.lit(0))).alias("depth"), "a", "b", "chars")
    return taken.unionByName(own), begun.select("conv_id", F.col("turns").cast("long"))


def prefixes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, x1, x2, chars) of all prefixes, the empty one too."""
    of = lambda lane, c: (F.bit_xor, F.xxhash64(F.lit(lane), "depth", c))
    made = along(rows, ["conv_id"], F.shiftright("depth", _CUT), ["depth"], {"x1": of(1, "a"), "x2": of(2, "b")})
    zero = F.lit(0).cast("long")
    empty = sizes.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("chars"))
    return made.select("conv_id", "depth", "x1", "x2", "chars").unionByName(empty)


def minima_of(prefix: DataFrame) -> DataFrame:
    """One row a node: depth, x1, x2, owner (the smallest conversation), n_convs, chars (of its last turn)."""
    return prefix.groupBy(*_PREFIX).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))


def _probed(rows: DataFrame, minima: DataFrame, at: Column, rounds: int) -> DataFrame:
    """Binary search of all ``rows`` (conv_id, lo, hi, below, ...) at once: each round asks who owns the prefix ``at``
    (a struct of depth, x1, x2 by column mid), and goes on to its left or right. ``below`` is the owner of the last one
    that wasn't the row's own. Rows that have settled ask again and change nothing."""
    known = minima.select(*_PREFIX, "owner")
    for _ in range(rounds):
        asked = rows.withColumn("mid", F.shiftright(F.col("lo") + F.col("hi"), 1)).withColumn("p", at)
        asked = asked.select("*", "p.*").join(known, _PREFIX)
        open_, own = F.col("lo") < F.col("hi"), F.col("owner") == F.col("conv_id")
        rows = asked.withColumns({
            "below": F.when(open_ & ~own, F.col("owner")).otherwise(F.col("below")),
            "lo": F.when(open_ & ~own, F.col("mid") + 1).otherwise(F.col("lo")),
            "hi": F.when(open_ & own, F.col("mid")).otherwise(F.col("hi")),
        }).drop("mid", "p", "owner", *_PREFIX)
    return rows


def _rounds(n: int) -> int:
    """Rounds in which n + 1 places come down to one."""
    return math.ceil(math.log2(n + 1))


def search(prefix: DataFrame, minima: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv_id, turns, top, parent): ``top`` is the first depth that the conversation owns, turns + 1 if it owns
    none; ``parent`` the owner of the prefix before it, null for the root's."""
    cut = F.floor(F.col("depth") / block)
    parts = prefix.groupBy("conv_id", cut.alias("part")).agg(F.sort_array(F.collect_list(F.struct(*_PREFIX))).alias("ps")).checkpoint()
    longest = parts.agg(F.max("part"), F.max(F.size("ps"))).first()
    state = sizes.select("conv_id", "turns", F.floor(F.col("turns") / block).alias("last"), F.lit(None).cast("long").alias("below"))
    if longest[0]:
        state = _part_of(state, parts, minima, _rounds(longest[0]))
    else:
        state = state.select("conv_id", "turns", "below", "last", F.lit(0).cast("long").alias("part"))
    rows = state.join(parts, ["conv_id", "part"]).withColumns({"lo": F.lit(0), "hi": F.size("ps")})
    inside = F.element_at("ps", (F.least(F.col("mid"), F.size("ps") - 1) + 1).cast("int"))
    found = _probed(rows, minima, inside, _rounds(longest[1] or 0))
    return found.select("conv_id", "turns", (F.col("part") * block + F.col("lo")).alias("top"), F.col("below").alias("parent"))


def _part_of(state: DataFrame, parts: DataFrame, minima: DataFrame, rounds: int) -> DataFrame:
    """The first part whose last prefix is owned, or the last part, for conversations with more than one."""
    ends = parts.select("conv_id", F.col("part").alias("mid"), F.element_at("ps", -1).alias("p"))
    known = minima.select(*_PREFIX, "owner")
    rows = state.where("last > 0").withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("last")})
    for _ in range(rounds):
        asked = rows.withColumn("mid", F.shiftright(F.col("lo") + F.col("hi"), 1)).join(ends, ["conv_id", "mid"]).select("*", "p.*").drop("p").join(known, _PREFIX)
        open_, own = F.col("lo") < F.col("hi"), F.col("owner") == F.col("conv_id")
        rows = asked.select(
            "conv_id", "turns", "last",
            F.when(open_ & ~own, F.col("owner")).otherwise(F.col("below")).alias("below"),
            F.when(open_ & ~own, F.col("mid") + 1).otherwise(F.col("lo")).alias("lo"),
            F.when(open_ & own, F.col("mid")).otherwise(F.col("hi")).alias("hi"),
        )
    long_ = rows.select("conv_id", "turns", "below", "last", F.col("lo").alias("part")).checkpoint()
    return state.where("last = 0").select("conv_id", "turns", "below", "last", F.lit(0).cast("long").alias("part")).unionByName(long_)


def subtree_sums(chains: DataFrame, names: list[str], max_rounds: int = 64) -> DataFrame:
    """``chains`` (conv_id, parent, and the sums ``names``) with the sums over all chains below added: in every round a
    chain gets what its 2^k-th descendants have gathered. A round is one aggregate and two joins; only a count comes to
    the driver."""
    rows = chains.select("conv_id", F.col("parent").alias("up"), *names).checkpoint()
    for _ in range(max_rounds):
        if rows.where("up is not null").isEmpty():
            return rows.drop("up")
        given = rows.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(n).alias(f"more_{n}") for n in names])
        ups = rows.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        moved = rows.join(ups, "up", "left").select("conv_id", F.col("next").alias("up"), *names)
        rows = moved.join(given, "conv_id", "left").select("conv_id", "up", *[(F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in names]).checkpoint()
    raise RuntimeError(f"chains hang in more than 2^{max_rounds} levels")


def ends_digest(ends: DataFrame) -> DataFrame:
    """Rows (owner, depth, ends_sha256) of rows (owner, depth, conv_id): SHA-256 of the ids in numeric order, comma-joined.
    Ids that share all but their last 16 bits become one row; a node with several rows is hashed row by row in order, as
    SHA-256 allows no other way, in constant memory."""
    texts = ends.groupBy("owner", "depth", F.shiftright("conv_id", _IDS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    parts = texts.groupBy("owner", "depth").agg(F.count("*").alias("parts"), F.min("ids").alias("ids"))
    small = parts.where("parts = 1").select("owner", "depth", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["owner", "depth", "ends_sha256"])

        node, digest = None, hashlib.sha256()
        for batch in batches:
            for owner, depth, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (owner, depth) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node:
                    yield row()
                node, digest = (owner, depth), hashlib.sha256(ids.encode())
        if node:
            yield row()

    large = texts.join(parts.where("parts > 1").select("owner", "depth"), ["owner", "depth"])
    large = large.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part").select("owner", "depth", "ids")
    return small.unionByName(large.mapInArrow(hashed, "owner long, depth long, ends_sha256 string"))


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 100, most: int = 6, block: int = BLOCK) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (childless nodes below, itself included), saved_tokens (over the nodes below and itself, (n_convs - 1) times
    the code points of the last turn's text), ends_sha256 (of the members without a further turn).

    Null turns come first; null roles and texts are empty; a row without conv_id is left out. Repeated rows are turns of
    their own. Turns with equal numbers are in the order of their hashes. Conversations may be left without turns: they
    end at the root. Other columns are ignored. No conversation: no node, not even a root."""
    prepare(conversations.sparkSession)
    rows, sizes = rebuilt(turns_of(conversations, conv_id, turn, role, text), group, most)
    prefix = prefixes(rows, sizes).checkpoint()
    minima = minima_of(prefix).checkpoint()
    found = search(prefix, minima, sizes, block).checkpoint()
    return _nodes(minima, found)


def _nodes(minima: DataFrame, found: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    own = found.where("top <= turns")
    hung = own.where("parent is not null").select("conv_id", "parent", (F.col("top") - 1).alias("depth"))
    branches = hung.groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count("*").alias("branches"))
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")).join(branches, ["conv_id", "depth"], "left")
    nodes = nodes.join(own.select("conv_id", "turns"), "conv_id")
    nodes = nodes.select("conv_id", "depth", "n_convs", "saved", (F.coalesce("branches", zero) + (F.col("depth") < F.col("turns")).cast("long")).alias("n_children")).checkpoint()
    weights = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    totals = subtree_sums(own.select("conv_id", "parent").join(weights, "conv_id"), ["saved", "leaves"]).checkpoint()
    given = hung.join(totals, "conv_id").groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.sum("saved").alias("below_saved"), F.sum("leaves").alias("below_leaves"))
    local = nodes.join(given, ["conv_id", "depth"], "left").withColumns({
        "own_saved": F.col("saved") + F.coalesce("below_saved", zero),
        "own_leaves": (F.col("n_children") == 0).cast("long") + F.coalesce("below_leaves", zero),
    }).select("conv_id", "depth", "n_convs", "n_children", "own_saved", "own_leaves")
    up_to = along(local, ["conv_id"], F.shiftright("depth", _CUT), ["depth"], {"to_saved": (F.sum, F.col("own_saved")), "to_leaves": (F.sum, F.col("own_leaves"))})
    below = lambda n: (F.col(n) - F.col(f"to_{n}") + F.col(f"own_{n}")).cast("long")
    whole = up_to.join(totals, "conv_id").join(own.select("conv_id", "top", "parent"), "conv_id")
    last = found.select(F.when(F.col("top") <= F.col("turns"), F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("turns").alias("depth"), "conv_id")
    ends = ends_digest(last).withColumnRenamed("owner", "conv_id")
    return whole.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        below("leaves").alias("n_leaves"),
        below("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


__all__ = ["ends_digest", "minima_of", "prefixes", "rebuilt", "search", "subtree_sums", "trie", "turns_of"]
