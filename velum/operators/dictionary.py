"""Dictionary substitution, its inverse, and what can be asked about matches.

Rules come from a list or from a table of mappings. A list becomes a chain of patterns; a table becomes an automaton
that is sent to the tasks in blocks of bounded size, so that no join with the texts is needed. Rules run from the longest
to the shortest; each sees what the ones before left.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from velum.functions.events import STATE, Stage, event, run, state, when_found
from velum.functions.regex import IGNORE_CASE, B, blocks_sql, given, hits, literal, pairs_sql, places_sql, quote, quote_column, replace_all, replacement_column, with_offsets
from velum.operators.pieces import Automaton, Rule, fold
from velum.session import checkpoints, importable, small_batches

#: Size of a table's rules that are sent to the tasks at once: their characters, and RULE_BYTES for each.
BLOCK_BYTES = 16 << 20
RULE_BYTES = 32
#: Bytes of texts that are sent to a worker at once, or returned, and rows or events that it returns at once, beside those
#: of one text.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 50_000
#: Rules that are objects at once while an automaton is made of them.
FEW_ROWS = 4096
#: Characters of a text that are cut at once.
CHUNK = 4096


@dataclass(frozen=True)
class Mapping:
    real: str
    substitute: str
    category: str = "general"
    case_sensitive: bool = False
    enabled: bool = True

    @property
    def pattern(self) -> str:
        return ("" if self.case_sensitive else IGNORE_CASE) + quote(self.real)

    def swapped(self) -> Mapping:
        return Mapping(self.substitute, self.real, self.category, self.case_sensitive, self.enabled)


def usable(mappings: Iterable[Mapping]) -> list[Mapping]:
    """Enabled rules with both sides, longest first; equals in their order."""
    return sorted((m for m in mappings if m.enabled and m.real and m.substitute), key=lambda m: -len(m.real))


def _apply(text: Column, m: Mapping) -> Column:
    found = lambda: state(replace_all(text, m.pattern, m.substitute), F.transform(hits(text, m.pattern), lambda x: event(x, m.substitute, m.category or "general", None)))
    return when_found(text, m.pattern, found)


def stages(mappings: Iterable[Mapping]) -> list[Stage]:
    return [partial(_apply, m=m) for m in usable(mappings)]


def substitute(text: Column, mappings: Iterable[Mapping]) -> Column:
    """struct<text, events>, for some twenty rules at most; ``events.apply`` takes any number of ``stages``. Null stays
    null."""
    return run(text, stages(mappings))


def reveal(text: Column, mappings: Iterable[Mapping]) -> Column:
    """The text with substitutes turned back, longest substitute first."""
    for m in usable(m.swapped() for m in mappings):
        text = replace_all(text, m.pattern, m.substitute)
    return text


def counts(text: Column, mappings: Iterable[Mapping]) -> Column:
    """array<struct<real, n>>: matches of each enabled rule in the text as it is."""
    return F.array(*[F.struct(F.lit(m.real).alias("real"), F.coalesce(F.regexp_count(text, F.lit(m.pattern)), F.lit(0)).cast("long").alias("n")) for m in mappings if m.enabled and m.real])


def scan(text: Column, mappings: Iterable[Mapping]) -> Column:
    """array<struct<real, substitute, category>> of the enabled rules that occur, in their order."""
    own = [m for m in mappings if m.enabled and m.real]
    rules = [F.struct(F.lit(m.real).alias("real"), F.lit(m.substitute).alias("substitute"), F.lit(m.category or "general").alias("category"), F.coalesce(text.rlike(m.pattern), F.lit(False)).alias("found")) for m in own]
    kind = "array<struct<real:string,substitute:string,category:string>>"
    if not rules:
        return F.array().cast(kind)
    return F.transform(F.filter(F.array(*rules), lambda r: r["found"]), lambda r: F.struct(r["real"], r["substitute"], r["category"])).cast(kind)


def diff(text: Column, mappings: Iterable[Mapping], dedupe: bool = False) -> Column:
    """array<struct<type, text, original, replacement>>: the text cut at all matches of all rules. Matches may overlap,
    and then the cut goes back; ``dedupe`` drops a match that begins before the last one ended."""
    rules = usable(mappings)
    if not rules:
        parts = "CAST(array() AS array<struct<start:int,rule:int,value:string,substitute:string>>)"
    else:
        parts = f"array_sort(concat({', '.join(_marked(k, m) for k, m in enumerate(rules))}))"
    kept = "w"
    if dedupe:
        kept = blocks_sql("w", "CASE WHEN x.start >= acc.at THEN named_struct('at', x.start + length(x.value), 'out', concat(acc.out, array(x))) ELSE acc END", "0", "array<struct<start:int,rule:int,value:string,substitute:string>>")
    plain = lambda text: f"named_struct('type', 'unchanged', 'text', {text}, 'original', CAST(NULL AS STRING), 'replacement', CAST(NULL AS STRING))"
    none = "CAST(array() AS array<struct<type:string,text:string,original:string,replacement:string>>)"
    end = lambda i: f"CASE WHEN {i} < 0 THEN 0 ELSE d[greatest({i}, 0)].start + length(d[greatest({i}, 0)].value) END"  # noqa: E731  where the match before ended
    own = "array(named_struct('type', 'substituted', 'text', CAST(NULL AS STRING), 'original', x.value, 'replacement', x.substitute))"
    gap = f"CASE WHEN x.start > {end('j - 1')} THEN array({plain(_piece(end("j - 1"), "x.start"))}) ELSE {none} END"
    rest = f"CASE WHEN {end('size(d) - 1')} < length(t) THEN array({plain(_piece(end("size(d) - 1"), "length(t)"))}) ELSE {none} END"
    cut = f"concat(flatten(transform(d, (x, j) -> concat({gap}, {own}))), {rest})"
    chunks = f"transform(sequence(0, length(t) DIV {CHUNK}), c -> substr(t, CAST(c * {CHUNK} + 1 AS INT), {CHUNK}))"
    cut = f"transform(array({chunks}), ch -> CASE WHEN size(d) > 0 THEN {cut} ELSE {rest} END)[0]"
    return given(text, f"CASE WHEN t IS NOT NULL THEN transform(transform(array({parts}), w -> {kept}), d -> {cut})[0] END")


def _piece(start: str, end: str) -> str:
    """The text from one place to another, from the chunks ``ch``: a substring of the whole text is looked for from its
    beginning."""
    return f"transform(array(named_struct('a', CAST({start} AS BIGINT), 'z', CAST({end} AS BIGINT))), p -> array_join(transform(sequence(p.a DIV {CHUNK}, (p.z - 1) DIV {CHUNK}), c -> substr(ch[CAST(c AS INT)], CAST(greatest(p.a - c * {CHUNK}, 0) + 1 AS INT), CAST(least(p.z, (c + 1) * {CHUNK}) - greatest(p.a, c * {CHUNK}) AS INT))), ''))[0]"


def _marked(k: int, m: Mapping) -> str:
    """The places of a rule, in SQL."""
    places = f"transform(array({pairs_sql('t', m.pattern)}), q -> {places_sql('q')})[0]"
    return f"transform({places}, v -> named_struct('start', v.start, 'rule', {k}, 'value', v.value, 'substitute', {literal(m.substitute)}))"


def highlight_pattern(term: str, case_sensitive: bool = False) -> str:
    """The term, not within a longer word where it begins or ends with a word character itself."""
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    return ("" if case_sensitive else IGNORE_CASE) + (B if word(term[0]) else "") + quote(term) + (B if word(term[-1]) else "")


def highlights(text: Column, terms: Iterable[str], min_length: int = 2) -> Column:
    """array<struct<term, start, end>>: all places of all terms; overlaps stay."""
    empty = F.array().cast("array<struct<term:string,start:int,end:int>>")
    parts = [F.transform(with_offsets(text, highlight_pattern(t)), _ranger(t)) for t in terms if t]
    return F.when(F.length(text) >= min_length, F.concat(empty, *parts)).otherwise(empty)


def _ranger(term: str) -> Stage:
    return lambda x: F.struct(F.lit(term).alias("term"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"))


# --- rules from a table ---------------------------------------------------------------------------------------------


def rules_of(mappings: DataFrame, swap: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Rule]]:
    """Blocks of rules, longest first, from a table (real, substitute, category, case_sensitive, enabled). The table's
    order doesn't matter: equal lengths go by their text. One block at a time is held by the driver."""
    a, b = ("substitute", "real") if swap else ("real", "substitute")
    m = mappings.where(F.coalesce("enabled", F.lit(False)) & (F.col("real") != "") & (F.col("substitute") != ""))
    rows = m.select(F.col(a).alias("key"), F.col(b).alias("to"), F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("case_sensitive", F.lit(False)).alias("cs")).orderBy(F.desc(F.length("key")), "key", "to", "category", "cs")
    yield from _in_blocks((Rule(*r) for r in rows.toLocalIterator()), block_bytes)


def _in_blocks(rules: Iterable[Rule], block_bytes: int) -> Iterator[list[Rule]]:
    block, size = [], 0
    for r in rules:
        block.append(r)
        size += len(r.real) + len(r.to) + len(r.category) + RULE_BYTES
        if size > block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def substitute_by_table(docs: DataFrame, mappings: DataFrame, text_col: str = "text", result_col: str = "result", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with struct<text, events> of the table's rules in ``result_col``. Rules are sent in blocks of bounded
    size, one automaton and one Arrow function each, and a text meets only the rules that occur in it, each at the cost of
    its places. Nothing is shuffled. With several blocks what one left is a checkpoint, so that a worker holds one
    automaton at a time."""
    small_batches(docs.sparkSession, BATCH_BYTES)
    docs, sent = docs.withColumn(result_col, state(F.col(text_col))), None
    for block in rules_of(mappings, block_bytes=block_bytes):
        if sent is not None:
            checkpoints(docs.sparkSession)
            docs = docs.checkpoint()
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(_packed(block))  # bounded by block_bytes
        held = fresh_name(docs, "after_block")
        docs = docs.withColumn(held, _applier(sent)(F.col(result_col)["text"]))
        docs = docs.withColumn(result_col, state(F.col(held)["text"], F.concat(F.col(result_col)["events"], F.col(held)["events"]))).drop(held)
    return docs


def _packed(block: list[Rule]) -> pa.Table:
    """Rules as columns, which take a fraction of the objects' memory in each worker."""
    kinds = {"real": pa.large_string(), "to": pa.large_string(), "category": pa.large_string(), "case_sensitive": pa.bool_()}
    return pa.table({name: pa.array((getattr(r, name) for r in block), kind) for name, kind in kinds.items()})


def _unpacked(block: pa.Table) -> list[Rule]:
    same: dict[str, str] = {}
    return [Rule(r, t, same.setdefault(c, c), cs) for part in block.to_batches(max_chunksize=BATCH_ROWS) for r, t, c, cs in zip(*(x.to_pylist() for x in part.columns), strict=True)]


class _Rules(Sequence[Rule]):
    """Rules that stay columns; one is an object while it is looked at."""

    def __init__(self, block: pa.Table):
        self.block = block
        self.columns = [c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in block.columns]

    def __len__(self) -> int:
        return len(self.block)

    def __getitem__(self, k: int) -> Rule:
        return Rule(*(c[k].as_py() for c in self.columns))

    def __iter__(self) -> Iterator[Rule]:
        for k in range(0, len(self), FEW_ROWS):
            yield from _unpacked(self.block.slice(k, FEW_ROWS))


def _applier(sent: Broadcast) -> Callable[[Column], Column]:
    names = ("original", "replaced", "category", "pattern")

    @F.arrow_udf(STATE)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Automaton(_Rules(sent.value))
        def told(texts: list[str | None], ends: array, events: tuple[list[str], ...]) -> pa.Array:
            columns = [*(pa.array(c, pa.string()) for c in events), pa.nulls(len(events[0]), pa.string())]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))
            return pa.StructArray.from_arrays([pa.array(texts, pa.string()), listed], ["text", "events"])

        for batch in batches:
            texts, ends, events, size = [], array("i", [0]), ([], [], []), 0
            for text in batch:
                new, found = known.substitute(text.as_py()) if text.is_valid else (None, [])
                texts.append(new)
                size += len(new or "")
                for column, values in zip(events, zip(*found, strict=True), strict=False):
                    column.extend(values)
                ends.append(len(events[0]))
                if len(events[0]) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield told(texts, ends, events)
                    texts, ends, events, size = [], array("i", [0]), ([], [], []), 0
            if texts:
                yield told(texts, ends, events)

    return apply


class _Finder:
    """Which rules occur, by an automaton of numbers: rules stay columns, but for the text of those that mind case."""

    def __init__(self, rules: pa.Table):
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.alike: dict[int, list[int]] = {}
        self.cased: dict[int, str] = {}
        k = 0
        for part in rules.to_batches(max_chunksize=BATCH_ROWS):
            for real, cased in zip(part["real"].to_pylist(), part["case_sensitive"].to_pylist(), strict=True):
                form = fold(real)
                first = self.found.get(form, -1)
                if first < 0:
                    self.found.add_word(form, k)
                else:
                    self.alike.setdefault(first, [first]).append(k)
                if cased:
                    self.cased[k] = real
                k += 1
        self.found.make_automaton()

    def occurring(self, text: str) -> list[int]:
        out: set[int] = set()
        for end, first in self.found.iter(fold(text)):
            for k in self.alike.get(first) or (first,):
                if k not in out:
                    real = self.cased.get(k)
                    if real is None or text.startswith(real, end + 1 - len(real)):
                        out.add(k)
        return sorted(out)


def _finding(docs: DataFrame, sent: Broadcast, id_col: str, text_col: str) -> DataFrame:
    schema = StructType([docs.schema[id_col], *(StructField(n, StringType()) for n in ("real", "substitute", "category"))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = sent.value
        known = _Finder(rules)
        columns = [rules[n].combine_chunks() for n in ("real", "to", "category")]

        def told(ids: pa.Array, rows: array, own: array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *(c.take(pa.array(own, pa.int64())).cast(pa.string()) for c in columns)], names=schema.names)

        for batch in batches:
            rows, own = array("q"), array("q")
            for k, text in enumerate(batch.column(1)):
                if text.is_valid:
                    here = known.occurring(text.as_py())
                    own.extend(here)
                    rows.extend([k] * len(here))
                    if len(own) >= BATCH_ROWS:
                        yield told(batch.column(0), rows, own)
                        rows, own = array("q"), array("q")
            yield told(batch.column(0), rows, own)

    return docs.select(id_col, text_col).mapInArrow(find, schema)


def fresh_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def scan_by_table(docs: DataFrame, mappings: DataFrame, id_col: str, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, real, substitute, category) of the rules that occur in each document, by one automaton a block of rules:
    texts aren't shuffled and no pair is made that doesn't match."""
    own = mappings.where(F.coalesce("enabled", F.lit(False)) & (F.col("real") != "")).select("real", F.coalesce("substitute", F.lit("")).alias("substitute"), F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("case_sensitive", F.lit(False)).alias("cs"))
    importable(small_batches(docs.sparkSession, BATCH_BYTES))
    out = docs.select(id_col, F.inline(F.array().cast("array<struct<real:string,substitute:string,category:string>>")))
    for block in _in_blocks((Rule(*r) for r in own.toLocalIterator()), block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(_packed(block))  # bounded by block_bytes
        out = out.unionByName(_finding(docs, sent, id_col, text_col))
    return out


def session_pairs(events: DataFrame, pairs: DataFrame, session_col: str = "session") -> DataFrame:
    """(session, source, target): what may be turned back in a session. ``events`` (session, seq, original, replaced)
    are what was emitted, the last original of equal substitutes (in any case) counting; ``pairs`` (real, substitute)
    are the configured ones. A configured pair is taken if its substitute was emitted; emitted ones without any are
    taken from the events."""
    emitted = events.where((F.col("replaced") != "") & (F.col("original") != "")).groupBy(session_col, F.lower("replaced").alias("key")).agg(F.max_by("original", "seq").alias("original"))
    known = pairs.where((F.col("real") != "") & (F.col("substitute") != "")).select("real", "substitute", F.lower("substitute").alias("key"))
    configured = emitted.join(known, "key").select(session_col, F.col("substitute").alias("source"), F.col("real").alias("target"))
    rest = emitted.join(known.select("key").distinct(), "key", "left_anti").select(session_col, F.col("key").alias("source"), F.col("original").alias("target"))
    return configured.unionByName(rest)


def reveal_by_session(messages: DataFrame, pairs: DataFrame, session_col: str = "session", text_col: str = "text", result_col: str = "revealed") -> DataFrame:
    """``messages`` with their text turned back by the pairs of their session, the longest source first."""
    rule = F.struct((-F.length("source")).alias("n"), F.col("source"), F.col("target"))
    rules = pairs.groupBy(session_col).agg(F.array_sort(F.collect_set(rule)).alias("session_rules"))
    back = lambda t, r: F.regexp_replace(t, F.concat(F.lit(IGNORE_CASE), quote_column(r["source"])), replacement_column(r["target"]))
    joined = messages.join(rules, session_col, "left")
    return joined.withColumn(result_col, F.when(F.col("session_rules").isNull(), F.col(text_col)).otherwise(F.aggregate("session_rules", F.col(text_col), back))).drop("session_rules")


__all__ = ["Mapping", "counts", "diff", "highlights", "reveal", "reveal_by_session", "scan", "scan_by_table", "session_pairs", "stages", "substitute", "substitute_by_table", "usable"]
