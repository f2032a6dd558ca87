"""Regular-expression building blocks as Column expressions.

Java's ``\\b`` is Unicode-aware and its ``$`` matches before a final line break; the patterns here use an ASCII boundary
and ``\\z``. User-supplied strings go into patterns and replacements as literals.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Boundary of ASCII words.
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def start(first: str) -> str:
    """The same where a match can only begin with one of the word characters ``first`` (a class's content): nearly all
    places fail at the first test, which is much cheaper than looking behind."""
    return f"(?=[{first}])(?<![A-Za-z0-9_])"


def word_start(literal: str) -> str:
    """The literal as a pattern, at a boundary. One that begins with a word character comes first, as other places fail
    at its first character, and what is before it is looked at only then."""
    own = quote(literal)
    return f"{own}(?<![A-Za-z0-9_]{own})" if re.match(r"[A-Za-z0-9_]", literal) else B + own


#: White space, with the Unicode spaces that Java's ``\\s`` leaves out.
S = r"[\s\x0B   -     　﻿]"
IGNORE_CASE = "(?iu)"

_META = re.compile(r"[.*+?^${}()|\[\]\\]")


def quote(literal: str) -> str:
    """The literal as a pattern."""
    return _META.sub(lambda m: "\\" + m[0], literal)


def quote_column(literal: Column) -> Column:
    """The same for a column of literals."""
    return F.regexp_replace(literal, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def replacement(literal: str) -> str:
    """The literal as a replacement: no group references."""
    return literal.replace("\\", "\\\\").replace("$", "\\$")


def replacement_column(literal: Column) -> Column:
    return F.replace(F.replace(literal, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def replace_all(text: Column, pattern: str, constant: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement(constant)))


def hits(text: Column, pattern: str | Column) -> Column:
    """All matches from left to right; none for null."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.coalesce(F.regexp_extract_all(text, p, F.lit(0)), F.array().cast("array<string>"))


def gaps(text: Column, pattern: str) -> Column:
    """What stands between the matches: one more than there are matches."""
    return F.split(text, pattern, -1)


def found_in(text: Column, pattern: str, needs: str | None = None, part: str | None = None) -> Column:
    """Whether the pattern occurs. ``needs`` is a literal without which it can't, ``part`` a cheaper pattern without which
    it can't; they are looked for first."""
    tests = [*([text.contains(needs)] if needs else []), *[text.rlike(p) for p in (part, pattern) if p]]
    return reduce(lambda x, y: x & y, tests)


def literal(text: str) -> str:
    """The text as a string of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def given(value: Column, body: str, name: str = "t") -> Column:
    """``body``, an expression in SQL, of ``value``, which it knows by ``name`` and which is computed once. A long
    expression is built by one parse instead of thousands of calls from Python."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def has_sql(t: str, needs: str | tuple[str, ...]) -> str:
    """Whether the text has one of the literals."""
    return " OR ".join(f"contains({t}, {literal(n)})" for n in ((needs,) if isinstance(needs, str) else needs))


def found_in_sql(t: str, pattern: str, needs: str | tuple[str, ...] | None = None, part: str | None = None) -> str:
    """``needs``: a literal without which the pattern can't occur, or several of which it has one. ``part``: a cheaper
    pattern without which it can't."""
    tests = [*([f"({has_sql(t, needs)})"] if needs else []), *[f"rlike({t}, {literal(p)})" for p in (part, pattern) if p]]
    return " AND ".join(tests)


#: Elements that are folded at once. A fold that appends copies what it has, so that a long array is folded in blocks.
FOLDED = 256
PLACES = "array<struct<start:int,value:string>>"


def blocks_sql(items: str, each: str, start: str, out: str) -> str:
    """A fold of the array ``items`` in linear time. ``each`` is the new (at, out) from ``acc`` and the element ``x``,
    where acc.at is what goes from one element to the next (``start`` first), and acc.out an array of type ``out``, to
    which it appends; the result is that array."""
    one = f"aggregate(slice({items}, b * {FOLDED} + 1, {FOLDED}), named_struct('at', o.at, 'out', CAST(array() AS {out})), (acc, x) -> {each})"
    grown = f"transform(array({one}), p -> named_struct('at', p.at, 'out', concat(o.out, array(p.out))))[0]"
    every = f"aggregate(sequence(0, CAST((size({items}) - 1) DIV {FOLDED} AS INT)), named_struct('at', {start}, 'out', CAST(array() AS array<{out}>)), (o, b) -> {grown})"
    return f"CASE WHEN size({items}) > 0 THEN flatten({every}.out) ELSE CAST(array() AS {out}) END"


def pairs_sql(t: str, pattern: str, test: str | None = None) -> str:
    """array<struct<gap: int, value: string>>: the matches, and how many characters stand before each. ``test`` is a
    condition without which there are none."""
    hits, gaps = f"regexp_extract_all({t}, {literal(pattern)}, 0)", f"split({t}, {literal(pattern)}, -1)"
    if test:
        hits = f"CASE WHEN {test} THEN {hits} ELSE CAST(array() AS array<string>) END"
    found = f"zip_with(slice({gaps}, 1, size(h)), h, (g, v) -> named_struct('gap', length(g), 'value', v))"
    return f"transform(array({hits}), h -> CASE WHEN size(h) > 0 THEN {found} ELSE CAST(array() AS array<struct<gap:int,value:string>>) END)[0]"


def places_sql(pairs: str) -> str:
    """array<struct<start: int, value: string>> of such pairs, starts in characters from 0."""
    return blocks_sql(pairs, "named_struct('at', acc.at + x.gap + length(x.value), 'out', concat(acc.out, array(named_struct('start', acc.at + x.gap, 'value', x.value))))", "0", PLACES)


def with_offsets(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start: int, value: string>> of all matches, starts in characters from 0; none for null."""
    pairs = pairs_sql("t", pattern, has_sql("t", needs) if needs else None)
    return given(text, f"transform(array({pairs}), q -> {places_sql('q')})[0]")


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Every match replaced by ``change`` of it, computed on the match alone."""

    def build(found: Column) -> Column:
        between = gaps(text, pattern)
        parts = F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.transform(found, lambda m: change(m)), lambda g, h: F.concat(g, h))
        return F.concat(F.array_join(parts, ""), F.element_at(between, -1))

    return F.when(text.rlike(pattern), let(hits(text, pattern), build)).otherwise(text)
