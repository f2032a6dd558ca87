"""Texts under prefixes: which of many prefixes a text begins with, without comparing each text with each prefix.

The prefixes are an index by length and hash. A distinct text asks for its own beginnings of the lengths that prefixes
have, which is an equality join on 128 bits; the longest that is found wins. Where the index is small enough to send, no
question is shuffled; beyond that the questions are, as some forty bytes each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.names import unused

#: Prefixes that are sent to all tasks, some twenty bytes each; more are joined by a shuffle.
SENT_PREFIXES = 2_000_000


def _digest(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def longest_prefix(rows: DataFrame, prefixes: DataFrame, text_col: str = "url", prefix_col: str = "domain", name: str = "prefix", sent: int = SENT_PREFIXES) -> DataFrame:
    """``rows`` with the longest of ``prefixes`` that the text begins with in ``name``; null if there is none, and for a
    null text. An empty prefix is one of every text; null ones and repeats don't count. Letter case counts. Only the
    lengths that prefixes have come to the driver. A text that many rows share is asked for once."""
    known = prefixes.select(F.col(prefix_col).alias("p")).where("p is not null").distinct()
    h1, h2 = _digest(F.col("p"))
    known = known.select(F.char_length("p").alias("n"), h1.alias("h1"), h2.alias("h2"))
    by_length = known.groupBy("n").count().collect()
    lengths = sorted(r.n for r in by_length)
    if not lengths:
        return rows.withColumn(name, F.lit(None).cast("string"))
    if sum(r["count"] for r in by_length) <= sent:
        known = F.broadcast(known)
    k1, k2 = _digest(F.col("t"))
    begin1, begin2 = _digest(F.expr("left(t, n)"))
    texts = rows.select(F.col(text_col).alias("t")).where("t is not null").distinct()
    possible = F.filter(F.lit(lengths), lambda n: n <= F.char_length("t"))
    asked = texts.select("t", F.explode(possible).alias("n")).select(k1.alias("k1"), k2.alias("k2"), "n", begin1.alias("h1"), begin2.alias("h2"))
    best = asked.join(known, ["n", "h1", "h2"]).groupBy("k1", "k2").agg(F.max("n").alias("n"))
    c1, c2, n = unused((*rows.columns, name), "k1", "k2", "n")
    own1, own2 = _digest(F.col(text_col))
    best = best.select(F.col("k1").alias(c1), F.col("k2").alias(c2), F.col("n").alias(n))
    found = rows.withColumns({c1: own1, c2: own2}).join(best, [c1, c2], "left")
    own = F.when(F.col(text_col).isNotNull(), F.left(F.col(text_col), F.col(n)))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], own.alias(name))


def under_prefix(rows: DataFrame, prefixes: DataFrame, text_col: str = "url", prefix_col: str = "domain", sent: int = SENT_PREFIXES) -> DataFrame:
    """The rows whose text begins with any of the prefixes."""
    (name,) = unused(rows, "prefix")
    return longest_prefix(rows, prefixes, text_col, prefix_col, name, sent).where(F.col(name).isNotNull()).drop(name)


__all__ = ["longest_prefix", "under_prefix"]
