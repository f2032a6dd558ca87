"""Thousands of custom patterns from a table: only those that can match a text are tried on it.

Nearly every pattern has a literal without which it can't match. A text gets the patterns whose literal it has, in their
order; the JVM then applies these, each to what the ones before left. The literals of a small table are one automaton,
which is sent to the tasks; those of a larger one meet the texts by a join, so that each text is read once, not once for
every block of patterns. A literal may also be brought in by a replacement: patterns for which that is possible are tried
on every text that has any other, as are patterns without a literal on all texts. So the result is that of trying all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from velum.functions.events import EVENTS, event, state
from velum.functions.names import unused
from velum.functions.regex import let, replacement, replacement_column
from velum.operators import lookup
from velum.operators.lookup import folded as _folded
from velum.session import checkpoints, importable, small_batches

#: Characters of patterns that are sent to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Bytes of texts that a worker gets at once, beside those of one text.
BATCH_BYTES = 4 << 20
#: Characters of a class that is spelled out, and literals that a pattern has then, at most.
FEW, MANY = 4, 8
#: Characters of a secret that its event shows.
STUB = 8
_OPTIONAL = ("?", "*", "{0")
_ESCAPED = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


@dataclass(frozen=True, slots=True)
class Custom:
    """A pattern; ``literal`` is its ``literal_of`` where that is known."""

    name: str
    pattern: str
    redact: str
    literal: str | None = None


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether Java takes the pattern; asked of the driver's JVM, without a job."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # which PatternSyntaxException is
        return False
    return True


def compiling(pattern: Column) -> Column:
    """The same for a column, in the tasks: a call of the driver's JVM for each of a million patterns takes 20 minutes."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def _literals(pattern: Column) -> Column:
    @F.arrow_udf("string")
    def literals(patterns: pa.Array) -> pa.Array:
        return pa.array([literal_of(p) for p in patterns.to_pylist()], pa.string())

    return literals(pattern)


def literal_of(pattern: str) -> str:
    """The longest run of characters, without case, that every match of the pattern has; '' if none is certain."""
    if re.search(r"\(\?[A-Za-z]*x", pattern):
        return ""  # white space may not count
    return _folded("".join(max(_runs(pattern), key=len, default=[])))


def literals_of(pattern: str) -> list[str]:
    """Literals, without case, of which every match of the pattern has one, as long as they can be; none if that isn't
    certain. Small classes are spelled out: a number's literal would be found in every number that it begins."""
    if re.search(r"\(\?[A-Za-z]*x", pattern):
        return []
    windows = [_window(run) for run in _runs(pattern, classes=True)]
    best = max(windows, key=lambda w: (len(w), -math.prod(map(len, w))), default=[])
    return sorted({_folded("".join(x)) for x in product(*best)}) if best else []


def _window(run: list[str]) -> list[str]:
    """The longest part of a run with few literals, the last of several."""
    best, begin, many = [], 0, 1
    for end, piece in enumerate(run, 1):
        many *= len(piece)
        while many > MANY or end - begin > lookup.LONGEST:
            many //= len(run[begin])
            begin += 1
        if end - begin >= len(best):
            best = run[begin:end]
    return best


def _runs(pattern: str, classes: bool = False) -> list[list[str]]:
    """Certain runs of a pattern, each place as the characters that can be there: one, or those of a small class if
    ``classes``; none if it has alternatives."""
    runs, run, at, n = [], [], 0, len(pattern)

    def flush() -> None:
        nonlocal run
        if run:
            runs.append(run)
        run = []

    while at < n:
        c = pattern[at]
        inner, piece, end = [], None, at + 1
        if c == "\\":
            escaped = pattern[at + 1 : at + 2]
            end = at + 2
            if escaped == "Q":
                close = pattern.find("\\E", end)
                close = n if close < 0 else close
                quoted, end = pattern[end:close], close + 2
                if not quoted:
                    at = end
                    continue
                run, piece = [*run, *quoted[:-1]], quoted[-1]  # what follows counts the last character
                escaped = ""
            if escaped:
                piece = _ESCAPED.get(escaped) if escaped.isalnum() else escaped
            if piece is None:
                end = _after_escape(pattern, at)
        elif c == "|":
            return []
        elif c == "[":
            end = _after_class(pattern, at)
            piece = _small_class(pattern[at + 1 : end - 1]) if classes else None
        elif c == "(":
            end = _after_group(pattern, at)
            body, wanted = _body(pattern[at + 1 : end - 1])
            inner = _runs(body, classes) if wanted else []
        elif c not in ".^$)":
            piece = c
        rest = pattern[end : end + 2]
        optional, counted = rest.startswith(_OPTIONAL), rest[:1] in ("+", "{")
        at = _after_quantifier(pattern, end)
        while at > end and pattern.startswith("{", at):  # a count of what is counted already
            optional = optional or pattern.startswith("{0", at)
            at = _after_quantifier(pattern, at)
        if piece is None:
            flush()
            if not optional:
                runs += inner
        elif optional:
            flush()
        else:
            run.append(piece)
            if counted:
                flush()
    flush()
    return runs


def _after_escape(pattern: str, at: int) -> int:
    kind = pattern[at + 1 : at + 2]
    if kind and kind in "pPxNkgo" and pattern[at + 2 : at + 3] in ("{", "<"):
        close = pattern.find("}" if pattern[at + 2] == "{" else ">", at)
        return len(pattern) if close < 0 else close + 1
    width = {"x": 4, "u": 6, "c": 3, "p": 3, "P": 3}.get(kind, 2)
    if kind and kind in "0123456789":
        end = at + 2
        while end < len(pattern) and pattern[end].isdigit():
            end += 1
        return end
    return at + width


def _small_class(body: str) -> str | None:
    """The characters of a class that only lists a few."""
    out, at = "", 0
    while at < len(body):
        c = body[at]
        if c == "\\":
            at += 1
            c = body[at : at + 1]
            if not c or c.isalnum():
                return None
        elif c in "^-[]&":
            return None
        out += c
        at += 1
    return out if 0 < len(out) <= FEW else None


def _after_class(pattern: str, at: int) -> int:
    depth, k = 0, at
    while k < len(pattern):
        if pattern.startswith("\\Q", k):
            close = pattern.find("\\E", k)
            k = len(pattern) if close < 0 else close + 2
            continue
        if pattern[k] == "\\":
            k += 2
            continue
        depth += (pattern[k] == "[") - (pattern[k] == "]")
        opened = pattern[k] == "["
        k += 1
        if opened:
            k += pattern.startswith("^", k)
            k += pattern.startswith("]", k)  # at its beginning it doesn't end a class
        if not depth:
            return k
    return len(pattern)


def _after_group(pattern: str, at: int) -> int:
    depth, k = 0, at
    while k < len(pattern):
        if pattern.startswith("\\Q", k):
            close = pattern.find("\\E", k)
            k = len(pattern) if close < 0 else close + 2
            continue
        if pattern[k] == "\\":
            k += 2
            continue
        if pattern[k] == "[":
            k = _after_class(pattern, k)
            continue
        depth += (pattern[k] == "(") - (pattern[k] == ")")
        k += 1
        if not depth:
            return k
    return len(pattern)


def _body(group: str) -> tuple[str, bool]:
    """What a group holds, and whether it is a part of every match; looking ahead or back isn't."""
    if not group.startswith("?"):
        return group, True
    if group[1:2] in ("=", "!") or group[1:3] in ("<=", "<!"):
        return "", False
    if group[1:2] == "<":
        return group[group.find(">") + 1 :], True
    if group[1:2] == ">":
        return group[2:], True
    return (group.partition(":")[2], True) if ":" in group.partition("(")[0] else ("", False)


def _after_quantifier(pattern: str, at: int) -> int:
    if pattern[at : at + 1] == "{":
        close = pattern.find("}", at)
        at = len(pattern) if close < 0 else close + 1
    elif pattern[at : at + 1] in ("?", "*", "+"):
        at += 1
    else:
        return at
    return at + 1 if pattern[at : at + 1] in ("?", "+") else at


class Chooser:
    """Which patterns of a block may match a text."""

    def __init__(self, patterns: list[Custom]):
        self.patterns = patterns
        by_literal: dict[str, list[int]] = {}
        self.always = []
        for k, p in enumerate(patterns):
            literal = literal_of(p.pattern) if p.literal is None else p.literal
            if literal:
                by_literal.setdefault(literal, []).append(k)
            else:
                self.always.append(k)
        self.brought = sorted(k for literal in _brought_in(by_literal, {_folded(p.redact) for p in patterns}) for k in by_literal[literal])
        self.found = _automaton((literal, own) for literal, own in by_literal.items())

    def candidates(self, text: str) -> list[Custom]:
        chosen: set[int] = set(self.always)
        if self.found:
            for _, own in self.found.iter(_folded(text)):
                chosen.update(own)
        if chosen:
            chosen.update(self.brought)
        return [self.patterns[k] for k in sorted(chosen)]


def _automaton(words: Iterable[tuple[str, object]]) -> ahocorasick.Automaton | None:
    found = ahocorasick.Automaton()
    for word, value in words:
        found.add_word(word, value)
    if not len(found):
        return None
    found.make_automaton()
    return found


def _brought_in(literals: Iterable[str], replacements: set[str]) -> set[str]:
    """Literals that a replacement may complete: it has them, is in them, or ends or begins as they begin or end."""
    literals = set(literals)
    if "" in replacements:  # whatever stood before and behind meets
        return literals
    firsts, lasts = {r[0] for r in replacements}, {r[-1] for r in replacements}
    begun, ended = [x for x in literals if not firsts.isdisjoint(x)], [x for x in literals if not lasts.isdisjoint(x)]
    begins = {r[:k] for r in replacements for k in range(1, len(r) + 1)} if begun else set()
    ends = {r[k:] for r in replacements for k in range(len(r))} if ended else set()
    out = {x for x in ended if any(x[:k] in ends for k in range(1, len(x) + 1))} | {x for x in begun if any(x[k:] in begins for k in range(len(x)))}
    inside = _automaton((r, r) for r in replacements)
    out |= {x for x in literals if inside and any(True for _ in inside.iter(x))}
    whole = _automaton((x, x) for x in literals)
    return out | {x for r in replacements if whole for _, x in whole.iter(r)}


def _usable(patterns: DataFrame) -> DataFrame:
    """(ordinal, name, pattern, redact) of those that are enabled and not empty, with the default of redact."""
    redact = F.when(F.coalesce("redact", F.lit("")) != "", F.col("redact")).otherwise("[REDACTED]")
    return patterns.where(F.coalesce("enabled", F.lit(True)) & (F.col("pattern") != "")).select("ordinal", F.coalesce("name", F.lit("")).alias("name"), "pattern", redact.alias("redact"))


def patterns_of(patterns: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Custom]]:
    """Blocks of the patterns of a table (ordinal, name, pattern, redact, enabled), in their order; one at a time is held
    by the driver. Disabled ones, empty ones and those that Java can't compile are left out; the default of redact is
    ``[REDACTED]``."""
    importable(patterns.sparkSession)
    rows = _usable(patterns).where(compiling(F.col("pattern"))).withColumn("literal", _literals(F.col("pattern")))
    for block in _in_blocks(rows.orderBy(*_ORDER).toLocalIterator(), block_bytes):
        yield [Custom(r.name, r.pattern, r.redact, r.literal) for r in block]


_ORDER = ("ordinal", "name", "pattern", "redact")
_SIZE = ("name", "pattern", "redact")


def _in_blocks(rows: Iterable[Row], block_bytes: int) -> Iterator[list[Row]]:
    block, size = [], 0
    for r in rows:
        block.append(r)
        size += sum(len(r[c]) for c in _SIZE)
        if size > block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


_CHOSEN = "array<struct<name:string,pattern:string,redact:string,to:string>>"


def _chooser(sent: Broadcast) -> Callable[[Column], Column]:
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("name", "pattern", "redact", "to")]))

    @F.arrow_udf(_CHOSEN)
    def choose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Chooser(sent.value)
        for batch in batches:
            found = [known.candidates(t) if t is not None else [] for t in batch.to_pylist()]
            yield pa.array([[{"name": p.name, "pattern": p.pattern, "redact": p.redact, "to": replacement(p.redact)} for p in own] for own in found], kind)

    return choose


def redacted(text: Column, chosen: Column) -> Column:
    """struct<text, events> after the chosen patterns, the last one's events first."""

    def step(acc: Column, p: Column) -> Column:
        own = lambda m: event(F.concat(F.left(m, F.lit(STUB)), F.lit("...")), p["redact"], "secret", p["name"])
        after = lambda found: F.struct(F.regexp_replace(acc["text"], p["pattern"], p["to"]).alias("text"), F.concat(F.transform(found, own), acc["events"]).cast(EVENTS).alias("events"))
        return let(F.regexp_extract_all(acc["text"], p["pattern"], F.lit(0)), lambda found: F.when(F.size(found) > 0, after(found)).otherwise(acc))

    return let(text, lambda t: F.aggregate(chosen, state(t), step))


def redact_by_table(docs: DataFrame, patterns: DataFrame, text_col: str = "text", result_col: str = "result", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with struct<text, events> of the table's patterns in ``result_col``, each on what the ones before left.
    A null text stays null and has no events. A table of one block is sent to the tasks, and nothing is shuffled; with a
    larger one ``docs`` is a checkpoint, and texts and patterns are joined."""
    docs = docs.withColumn(result_col, state(F.col(text_col)))
    size = _usable(patterns).agg(F.sum(sum((F.length(c) for c in _SIZE), F.lit(0)))).first()[0]
    if (size or 0) > block_bytes:
        return _by_join(docs, patterns, result_col, block_bytes)
    for block in patterns_of(patterns, block_bytes):  # one at most
        sent = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_bytes
        (chosen,) = unused(docs, "chosen")
        docs = _after(docs.withColumn(chosen, _chooser(sent)(F.col(result_col)["text"])), result_col, chosen).drop(chosen)
    return docs


def _after(docs: DataFrame, result_col: str, chosen: str) -> DataFrame:
    before = F.col(result_col)
    return docs.withColumn(result_col, F.when(F.size(chosen) > 0, _and_before(redacted(before["text"], F.col(chosen)), before)).otherwise(before))


def _and_before(now: Column, before: Column) -> Column:
    return let(now, lambda r: state(r["text"], F.concat(r["events"], before["events"])))


# --- tables of any size ---------------------------------------------------------------------------------------------


def _by_join(docs: DataFrame, patterns: DataFrame, result_col: str, block_bytes: int) -> DataFrame:
    """Patterns are cut where those that are tried everywhere are a block; mostly they aren't many, and there is one part.
    A part reads the texts twice, for their windows and to change them, so that they are a checkpoint before."""
    spark = importable(checkpoints(small_batches(docs.sparkSession, BATCH_BYTES)))
    own = _usable(patterns).groupBy(*_ORDER).agg(F.count("*").cast("int").alias("times"))  # equal rows count as often
    own = own.where(compiling(F.col("pattern"))).withColumn("needs", _needs(F.col("pattern"))).checkpoint()
    literals = own.select(*_ORDER, "times", F.inline("needs"))
    known = lookup.filter_of(literals)
    sent = spark.sparkContext.broadcast(known) if known else None
    everywhere = own.where(F.size("needs") == 0).select(*_ORDER, "times", F.lit(True).alias("always"))
    if sent:
        brought = literals.join(_brought(own, literals, sent), "h", "left_semi").select(*_ORDER, "times").distinct()
        everywhere = everywhere.unionByName(brought.withColumn("always", F.lit(False)))
    after: Row | None = None
    docs = docs.checkpoint()
    for block, last in _with_last(_in_blocks(everywhere.orderBy(*_ORDER).toLocalIterator(), block_bytes)):
        if after:
            docs = docs.checkpoint()
        part = literals
        for edge, wanted in ((after, lambda a, b: a > b), (None if last else block[-1], lambda a, b: a <= b)):
            if edge:
                part = part.where(wanted(F.struct(*_ORDER), F.struct(*[F.lit(edge[c]).cast(own.schema[c].dataType).alias(c) for c in _ORDER])))
        docs = _part(docs, part, sent, block, result_col)
        after = block[-1] if block else None
    return docs


def _with_last(blocks: Iterable[list[Row]]) -> Iterator[tuple[list[Row], bool]]:
    """Each block, and whether it is the last; an empty one if there are none."""
    before: list[Row] | None = None
    for block in blocks:
        if before is not None:
            yield before, False
        before = block
    yield before or [], True


def _part(docs: DataFrame, literals: DataFrame, sent: Broadcast | None, block: list[Row], result_col: str) -> DataFrame:
    """``docs`` after the patterns of ``literals`` and those in ``block``, which are tried everywhere."""
    key, chosen, always, brought = unused(docs, "text_key", "chosen", "always", "brought")
    rule = StructType([*(literals.schema[c] for c in (*_ORDER, "times"))])
    columns = docs.columns
    if sent:
        text = F.col(result_col)["text"]
        docs = docs.withColumn(key, lookup.key_of(text))
        hits = lookup.windows(docs.select(F.col(key).alias("key"), text.alias("text")), sent)
        # by merges: by their estimated size Spark would broadcast hits, which are as many as the texts
        found = hits.join(literals.hint("merge"), "h").groupBy(F.col("key").alias(key)).agg(F.collect_set(F.struct(*rule.names)).alias(chosen))
        docs = docs.join(found.hint("merge"), key, "left")
    else:
        docs = docs.withColumn(chosen, F.lit(None).cast(ArrayType(rule)))
    none = F.array().cast(ArrayType(rule))
    rules = F.coalesce(F.col(chosen), none)
    if block:
        kinds = [[tuple(r[c] for c in rule.names) for r in block if r.always == kind] for kind in (True, False)]
        one = docs.sparkSession.createDataFrame([tuple(kinds)], StructType([StructField(always, ArrayType(rule)), StructField(brought, ArrayType(rule))]))
        docs = docs.crossJoin(F.broadcast(one))  # bounded by block_bytes
        rules = F.concat(rules, always)
        if kinds[1]:
            rules = F.when(F.size(rules) > 0, F.concat(rules, brought)).otherwise(rules)
    rules = F.array_sort(rules)
    if block and kinds[1]:  # found ones may be in both
        rules = let(rules, lambda s: F.filter(s, lambda p, k: (k == 0) | (p != F.get(s, k - 1))))
    as_often = F.transform(rules, lambda p: F.array_repeat(F.struct(p["name"].alias("name"), p["pattern"].alias("pattern"), p["redact"].alias("redact"), replacement_column(p["redact"]).alias("to")), p["times"]))
    return _after(docs.withColumn(chosen, F.flatten(as_often)), result_col, chosen).select(*columns)


def _needs(pattern: Column) -> Column:
    @F.arrow_udf(lookup.HASHED)
    def needs(patterns: pa.Array) -> pa.Array:
        return lookup.hashed([literals_of(p) for p in patterns.to_pylist()])

    return needs(pattern)


def _brought(own: DataFrame, literals: DataFrame, sent: Broadcast) -> DataFrame:
    """Hashes of literals that a replacement may complete, as ``_brought_in`` says, found by joins."""

    @F.arrow_udf("string")
    def low(redacts: pa.Array) -> pa.Array:
        return pa.array([_folded(r) for r in redacts.to_pylist()], pa.string())

    put = own.select("redact").distinct().select(low(F.col("redact")).alias("text")).distinct()
    inside = lookup.windows(put.select(lookup.key_of(F.col("text")).alias("key"), "text"), sent).select("h")
    (r,) = put.agg(F.collect_set(F.left("text", F.lit(1))).alias("firsts"), F.collect_set(F.right("text", F.lit(1))).alias("lasts")).collect()
    firsts, lasts = set(r.firsts), set(r.lasts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, own = [], []
            for x, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begins, ends = [k for k, c in enumerate(x) if c in firsts], [k + 1 for k, c in enumerate(x) if c in lasts]
                here = ["e" + x[:k] for k in ends] + ["b" + x[k:] for k in begins] + ["w" + x[a:z] for a in begins for z in ends if a < z]
                parts += here
                own += [h] * len(here)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(own, pa.int64())], names=["part", "h"])

    touching = literals.select("x", "h").mapInArrow(cut, "part string, h long")
    if not touching.limit(1).count():
        return inside
    longest = F.sequence(F.lit(1), F.least(F.length("text"), F.lit(lookup.LONGEST)))
    begun = F.transform(longest, lambda k: F.concat(F.lit("b"), F.left("text", k)))
    ended = F.transform(longest, lambda k: F.concat(F.lit("e"), F.right("text", k)))
    parts = put.select(F.explode(F.concat(begun, ended, F.array(F.concat(F.lit("w"), F.left("text", F.lit(lookup.LONGEST + 1)))))).alias("part"))
    return inside.unionByName(touching.join(parts.distinct(), "part", "left_semi").select("h"))


__all__ = ["Chooser", "Custom", "compiles", "compiling", "literal_of", "literals_of", "patterns_of", "redact_by_table", "redacted"]
