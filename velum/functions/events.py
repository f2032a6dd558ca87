"""A text and the replacement events made so far, as one struct that stages pass on.

An event is struct<original, replaced, category, pattern>. A stage is a function of a text column; stages run one after
the other, each on the text that the one before left, and inside one projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.regex import found_in, let

EVENT = "struct<original:string,replaced:string,category:string,pattern:string>"
EVENTS = f"array<{EVENT}>"
STATE = f"struct<text:string,events:{EVENTS}>"

Stage = Callable[[Column], Column]


def event(original: Column, replaced: Column | str, category: str | Column, pattern: str | Column | None) -> Column:
    value = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(original.alias("original"), value(replaced).alias("replaced"), value(category).alias("category"), value(pattern).alias("pattern"))


def none() -> Column:
    return F.array().cast(EVENTS)


def state(text: Column, events: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (none() if events is None else events).alias("events"))


def after(now: Column, stage: Stage, newest_first: bool = False) -> Column:
    """The state after one more stage."""

    def add(before: Column) -> Column:
        def joined(own: Column) -> Column:
            events = [own["events"], before["events"]] if newest_first else [before["events"], own["events"]]
            return state(own["text"], F.concat(*events))

        return let(stage(before["text"]), joined)

    return let(now, add)


def run(text: Column, stages: list[Stage], newest_first: bool = False) -> Column:
    """struct<text, events> after all stages, events in the order in which stages report them, or the last stage's
    first."""
    now = state(text)
    for stage in stages:
        now = after(now, stage, newest_first)
    return now


#: Stages in one expression. The analyzer resolves nested functions from the outside in, a level a pass.
TOGETHER = 8


def apply(df: DataFrame, text_col: str, stages: list[Stage], result_col: str = "result", newest_first: bool = False) -> DataFrame:
    """``df`` with struct<text, events> in ``result_col``, for any number of stages. They are added a few at a time; the
    optimizer makes one projection of them."""
    return extend(df.withColumn(result_col, state(F.col(text_col))), stages, result_col, newest_first)


def extend(df: DataFrame, stages: list[Stage], result_col: str = "result", newest_first: bool = False) -> DataFrame:
    """``df``, whose ``result_col`` is such a struct already, after more stages."""
    for k in range(0, len(stages), TOGETHER):
        now = F.col(result_col)
        for stage in stages[k : k + TOGETHER]:
            now = after(now, stage, newest_first)
        df = df.withColumn(result_col, now)
    return df


def extend_each(df: DataFrame, stages: list[Stage], states_col: str) -> DataFrame:
    """The same for a column of arrays of such structs: every element after the stages."""

    def together(some: list[Stage]) -> Callable[[Column], Column]:
        def chain(now: Column) -> Column:
            for stage in some:
                now = after(now, stage)
            return now

        return chain

    for k in range(0, len(stages), TOGETHER):
        df = df.withColumn(states_col, F.transform(states_col, together(stages[k : k + TOGETHER])))
    return df


def only_changed(df: DataFrame, result_col: str = "result") -> DataFrame:
    """The rows whose ``result_col`` has events. A plain filter would be pushed below the projection, and the whole
    chain would run twice; this one is part of it."""
    found = F.explode(F.filter(F.array(result_col), lambda r: F.size(r["events"]) > 0))
    return df.select(*[c for c in df.columns if c != result_col], found.alias(result_col))


def when_found(text: Column, pattern: str, then: Callable[[], Column], needs: str | None = None, part: str | None = None) -> Column:
    """``then`` for texts in which the pattern occurs; others pass unchanged without more work. ``needs`` is a literal
    without which it can't occur, ``part`` a cheaper pattern."""
    return F.when(found_in(text, pattern, needs, part), then()).otherwise(state(text))
