"""Numbers and totals that run along an order, with no task that sees the whole table or the whole of a hot group.

``placed`` sorts a table over range partitions. ``ranks`` numbers its rows by prefix sums of the ranges' counts. ``along``
makes totals in two passes: inside blocks of a group, and over the blocks' own totals, which are carried into the next
block. So a group that holds a third of all rows is as many tasks' work as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions.names import unused
from velum.session import checkpoints

#: Bits of a row's number inside its range, in what monotonically_increasing_id gives.
_BITS = 33


def placed(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` sorted by ``order`` over range partitions, with the long ``name``, which ascends in that order and has gaps.
    Rows that are equal in all of ``order`` are in one range. The result is a checkpoint: a lost executor changes no
    number that was given."""
    checkpoints(df.sparkSession)
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()).checkpoint()


def range_of(place: str | Column) -> Column:
    """The number of the range that a place is in."""
    return F.shiftright(place, _BITS)


def ranks(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """``df`` with the long ``name``: 1, 2, ... over the whole table in the given order. Counts of ranges come to the
    driver, one number a range, and go back as a broadcast of that size; an empty table stays empty."""
    place, number, before = unused((*df.columns, name), "place", "range", "before")
    rows = placed(df, *order, name=place).withColumn(number, range_of(place))
    counts = sorted(rows.groupBy(number).count().collect())
    offsets = [(r[0], b) for r, b in zip(counts, [0, *accumulate(r[1] for r in counts)], strict=False)]
    starts = df.sparkSession.createDataFrame(offsets, f"{number} long, {before} long")
    inside = F.col(place).bitwiseAND(F.lit((1 << _BITS) - 1))
    numbered = rows.join(F.broadcast(starts), number).withColumn(name, F.col(before) + inside + 1)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], name)


Total = tuple[Callable[[Column], Column], Column]


def _joined(kind: Callable[[Column], Column], carried: Column, own: Column) -> Column:
    if kind is F.sum:
        return F.coalesce(carried, F.lit(0)) + own
    if kind is F.bit_xor:
        return F.coalesce(carried, F.lit(0)).bitwiseXOR(own)
    if kind in (F.max, F.min):
        return (F.greatest if kind is F.max else F.least)(carried, own)  # nulls are passed over
    raise ValueError("totals are F.sum, F.bit_xor, F.max or F.min")


def along(rows: DataFrame, group: Sequence[str], block: Column, order: Sequence[str | Column], totals: dict[str, Total]) -> DataFrame:
    """``rows`` with one column for each of ``totals``, {name: (function, values)}: what the function (F.sum, F.bit_xor,
    F.max, F.min) makes of the values of the group's rows up to and with this one. ``block`` is a whole number that
    doesn't fall along the order and cuts large groups. Null keys are a group like others. A row is shuffled once, by
    block and group; between the blocks only their totals move."""
    n_keys = len(group) + 1
    b, *rest = unused((*rows.columns, *totals), "block", *[f"key{k}" for k in range(n_keys)], *[f"own_{n}" for n in totals], *[f"carried_{n}" for n in totals])
    keys, own, carried = rest[:n_keys], dict(zip(totals, rest[n_keys:], strict=False)), dict(zip(totals, rest[n_keys + len(totals) :], strict=True))
    cut = rows.withColumn(b, block)
    inside = Window.partitionBy(b, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.select("*", *[f(c).over(inside).alias(own[n]) for n, (f, c) in totals.items()])
    each = cut.groupBy(b, *group).agg(*[f(c).alias(own[n]) for n, (f, c) in totals.items()])
    earlier = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = each.select(*[F.col(c).alias(k) for c, k in zip((b, *group), keys, strict=True)], *[f(F.col(own[n])).over(earlier).alias(carried[n]) for n, (f, _) in totals.items()])
    sums = sums.where(reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in carried.values()]))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip((b, *group), keys, strict=True)])
    joined = within.join(sums, same, "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], *[_joined(f, F.col(carried[n]), F.col(own[n])).alias(n) for n, (f, _) in totals.items()])


def running(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], totals: dict[str, Total]) -> DataFrame:
    """``along`` for rows without dense numbers: the blocks are the ranges of the table sorted by group and order. Rows
    that are equal in all of that come in an order of their own, the same for all totals."""
    (place,) = unused((*df.columns, *totals), "place")
    rows = placed(df, *group, *order, name=place)
    return along(rows, group, range_of(place), [place], totals).drop(place)


__all__ = ["along", "placed", "range_of", "ranks", "running"]
