"""JSON texts of any shape, taken apart and put together by Spark's own functions.

A text is cut into its strings, keys and brackets, and what stands between them. One fold over these knows how deep it is
and whether a key above says to leave a value alone, and numbers the strings that may change. Changed strings go back in
place; numbers keep their spelling, keys their order, and white space outside strings goes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from velum.functions.regex import blocks_sql, given, let, literal

#: A key with its colon, a string, or a bracket; possessive, as strings may be long.
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+|[\[\]{}]'
PARTS = "struct<tokens:array<string>,gaps:array<string>,numbers:array<int>>"


def accepted_sql(t: str) -> str:
    """Whether Spark's parser takes the text ``t`` as one value. It doesn't mind what follows a value, so the text has to
    fit into an array and into an object: nothing that follows a value fits both."""
    return f"(try_parse_json(concat('[', {t}, ']')) IS NOT NULL AND try_parse_json(concat('{{\"v\":', {t}, '}}')) IS NOT NULL)"


def is_json(text: Column) -> Column:
    """Whether a text is JSON, nested some thousand deep at most. Keys may be there twice. False for null."""
    tokens, gaps = f"regexp_extract_all(t, {literal(TOKEN)}, 0)", f"split(t, {literal(TOKEN)}, -1)"
    # with all keys made different, what is refused for a doubled key is accepted
    named = f"transform({tokens}, (x, i) -> CASE WHEN endswith(x, ':') THEN concat('\"', i, '\":') ELSE x END)"
    skeleton = f"concat(array_join(zip_with(slice({gaps}, 1, size({gaps}) - 1), {named}, (g, x) -> concat(g, x)), ''), element_at({gaps}, -1))"
    nested = literal(r"^\s*[\[{]")
    test = f"{accepted_sql('t')} OR (rlike(t, {nested}) AND contains(t, ':') AND {accepted_sql(skeleton)})"
    return F.coalesce(given(text, test), F.lit(False))


def parts(text: Column, skip_keys: Iterable[str] = ()) -> Column:
    """PARTS of a JSON text: its tokens, the gaps around them (one more), and for each token the number, from 0, of the
    string value that it is; -1 for keys, brackets, values under one of ``skip_keys`` at any depth, and a text that is a
    string itself."""
    keys = ", ".join(literal(k) for k in skip_keys) or "NULL"
    name = "CASE WHEN contains(x, '\\\\') THEN map_keys(from_json(concat('{', x, '0}'), 'map<string,int>'))[0] ELSE regexp_replace(substr(x, 2), '\"\\\\s*:\\\\z', '') END"
    is_open, is_close, is_key = "x IN ('{', '[')", "x IN ('}', ']')", "endswith(x, ':')"
    own = "acc.at.skip = 0 AND NOT acc.at.held AND acc.at.depth > 0"
    at = ", ".join([
        f"'depth', acc.at.depth + CASE WHEN {is_open} THEN 1 WHEN {is_close} THEN -1 ELSE 0 END",
        f"'skip', CASE WHEN {is_open} AND acc.at.skip = 0 AND acc.at.held THEN acc.at.depth + 1 WHEN {is_close} AND acc.at.skip = acc.at.depth THEN 0 ELSE acc.at.skip END",
        f"'held', coalesce({is_key} AND {name} IN ({keys}), false)",
        f"'n', acc.at.n + CASE WHEN {is_open} OR {is_close} OR {is_key} THEN 0 WHEN {own} THEN 1 ELSE 0 END",
    ])
    number = f"CASE WHEN {is_open} OR {is_close} OR {is_key} THEN -1 WHEN {own} THEN acc.at.n ELSE -1 END"
    each = f"named_struct('at', named_struct({at}), 'out', concat(acc.out, array({number})))"
    start = "named_struct('depth', 0, 'skip', 0, 'held', false, 'n', 0)"
    numbers = blocks_sql("k", each, start, "array<int>")
    return given(text, f"transform(array(regexp_extract_all(t, {literal(TOKEN)}, 0)), k -> named_struct('tokens', k, 'gaps', split(t, {literal(TOKEN)}, -1), 'numbers', {numbers}))[0]").cast(PARTS)


def strings(taken: Column) -> Column:
    """The numbered strings of PARTS, decoded, in their order."""
    own = F.filter(F.arrays_zip(taken["tokens"].alias("token"), taken["numbers"].alias("number")), lambda x: x["number"] >= 0)
    return F.transform(own, lambda x: F.from_json(F.concat(F.lit("["), x["token"], F.lit("]")), "array<string>")[0])


def put_together(taken: Column, new: Column) -> Column:
    """The text of PARTS with the strings of ``new`` in place of the numbered ones; a null keeps a string as it is spelled."""
    bare = lambda g: F.regexp_replace(g, r"\s+", "")
    spelled = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]\z", 1)
    as_it_is = lambda t: F.when(t.endswith(":"), F.regexp_replace(t, r"\s+:\z", ":")).otherwise(t)

    def whole(v: Column) -> Column:
        def token(t: Column, k: Column) -> Column:
            changed = F.get(v["new"], F.greatest(k, F.lit(0)))
            return F.when((k >= 0) & changed.isNotNull(), spelled(changed)).otherwise(as_it_is(t))

        written = F.zip_with(v["p"]["tokens"], v["p"]["numbers"], token)
        before = F.transform(F.slice(v["p"]["gaps"], F.lit(1), F.size(v["p"]["tokens"])), bare)
        return F.concat(F.array_join(F.zip_with(before, written, lambda g, t: F.concat(g, t)), ""), bare(F.element_at(v["p"]["gaps"], -1)))

    return let(F.struct(taken.alias("p"), new.alias("new")), whole)


__all__ = ["is_json", "parts", "put_together", "strings"]
