"""Messages turned back in order: each by what its session had emitted before it, on batches of any size.

Two kinds of rows, what was emitted and the messages, are merged in the order of each session by reading sorted rows; the
state is one entry a distinct substitute. A session that holds a large share of all rows is cut into ranges of the order:
what a range begins with, the last entry of each substitute before it, is made by an aggregate and a window over ranges
and read before the range's own rows. So ranges are worked on side by side, and give what one pass would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from velum.functions.names import unused
from velum.functions.ranges import placed, range_of
from velum.operators.pieces import Automaton, Rule
from velum.session import importable

PAIRS = "array<struct<source:string,target:string,case_sensitive:boolean>>"


def _emitted(emitted: DataFrame, pairs: DataFrame | None, session: str, seq: str) -> DataFrame:
    """(session, seq, key, pairs): what each emission lets be turned back. If its substitute is a configured one, the
    configured pairs; else the emission itself."""
    own = emitted.where((F.col("replaced") != "") & (F.col("original") != "")).select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.lower("replaced").alias("key"), "original")
    itself = F.array(F.struct(F.col("key").alias("source"), F.col("original").alias("target"), F.lit(False).alias("case_sensitive"))).cast(PAIRS)
    if pairs is None:
        return own.select("session", "seq", "key", itself.alias("pairs"))
    cased = F.coalesce("case_sensitive", F.lit(False)) if "case_sensitive" in pairs.columns else F.lit(False)
    entry = F.struct(F.col("substitute").alias("source"), F.col("real").alias("target"), cased.alias("case_sensitive"))
    known = pairs.where((F.col("real") != "") & (F.col("substitute") != "")).groupBy(F.lower("substitute").alias("key")).agg(F.sort_array(F.collect_set(entry)).cast(PAIRS).alias("configured"))
    return own.join(known, "key", "left").select("session", "seq", "key", F.coalesce("configured", itself).alias("pairs"))


def _begun_with(rows: DataFrame) -> DataFrame:
    """(session, block, key, pairs): what each further range of a session begins with. ``rows``: session, block, place,
    key, pairs of all rows, key null for messages."""
    spans = rows.groupBy("session").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")  # at most one a range
    last = rows.where("key is not null").groupBy("session", "block", "key").agg(F.max_by("pairs", "place").alias("pairs"))
    s = F.broadcast(spans.withColumnRenamed("session", "spanning"))
    held = last.join(s, F.col("session").eqNullSafe(F.col("spanning"))).where("block < high")
    until = F.lead("block").over(Window.partitionBy("session", "key").orderBy("block"))
    return held.withColumn("until", F.coalesce(until, F.col("high"))).select("session", F.explode(F.sequence(F.col("block") + 1, F.col("until"))).alias("block"), "key", "pairs")


def reveal_in_order(messages: DataFrame, emitted: DataFrame, pairs: DataFrame | None = None, session: str = "session", seq: str = "seq", text: str = "text", result: str = "revealed") -> DataFrame:
    """``messages`` with their text turned back in ``result`` by what their session has emitted under smaller ``seq``,
    the longest substitute first. ``emitted`` has (session, seq, original, replaced); of equal substitutes, in any case,
    the last original counts. ``pairs`` (real, substitute, case_sensitive) are the configured ones, of which those apply
    whose substitute was emitted, instead of the emission itself. A null text stays null; a null session is one like
    others; emissions with an empty side don't count."""
    b, key, have, place = unused((*messages.columns, result), "block", "key", "pairs", "place")
    columns = messages.columns
    say = messages.withColumn(key, F.lit(None).cast("string")).withColumn(have, F.lit(None).cast(PAIRS))
    e = _emitted(emitted, pairs, session, seq)
    gave = e.select(F.col("session").alias(session), F.col("seq").alias(seq), F.col("key").alias(key), F.col("pairs").alias(have))
    # at equal seq messages come first: what is emitted with them isn't before them
    rows = placed(say.unionByName(gave, allowMissingColumns=True), session, seq, F.asc_nulls_first(key), have, name=place).withColumn(b, range_of(place))
    begun = _begun_with(rows.select(F.col(session).alias("session"), F.col(b).alias("block"), F.col(place).alias("place"), F.col(key).alias("key"), F.col(have).alias("pairs")))
    begun = begun.select(F.col("session").alias(session), F.col("block").alias(b), F.col("key").alias(key), F.col("pairs").alias(have), F.lit(-1).cast("long").alias(place))
    every = rows.unionByName(begun, allowMissingColumns=True)
    importable(messages.sparkSession)
    ordered = every.repartition(session, b).sortWithinPartitions(session, b, place)
    schema = StructType([*messages.schema.fields, StructField(result, StringType())])
    names = (columns.index(session), columns.index(text), len(columns), len(columns) + 1, len(columns) + 2)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, turn = None, {}, None
        where, what, emits, gives, cut = names
        for batch in batches:
            own, out = [], []
            sessions, keys, given, blocks = (batch.column(k).to_pylist() for k in (where, emits, gives, cut))
            texts = batch.column(what)
            for k, group in enumerate(zip(sessions, blocks, strict=True)):
                if at is None or group != at:
                    at, known, turn = group, {}, None
                if keys[k] is not None:
                    if known.get(keys[k]) != given[k]:
                        known[keys[k]], turn = given[k], None
                    continue
                if turn is None:
                    turn = _turner(known)
                value = texts[k].as_py()
                own.append(k)
                out.append(turn.substitute(value)[0] if value else value)
            if own:
                kept = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(columns)], pa.array(out, pa.string())], names=[*columns, result])

    return ordered.select(*[F.col(f"`{c}`") for c in columns], key, have, b).mapInArrow(merge, schema)


def _turner(known: dict[str, list[dict]]) -> Automaton:
    pairs = {(p["source"], p["target"], p["case_sensitive"]) for own in known.values() for p in own}
    return Automaton([Rule(s, t, "", c) for s, t, c in sorted(pairs, key=lambda p: (-len(p[0]), *p))])


__all__ = ["reveal_in_order"]
