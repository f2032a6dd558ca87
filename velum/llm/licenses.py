"""Licence scans: Aho-Corasick finds identifier tags and notice phrases; expressions are evaluated.

The automaton runs over the words of a document joined by spaces, so that a phrase is found where its words stand
consecutively, overlaps included. Where it meets an identifier tag, the licence expression after the tag is read from
the raw text and evaluated by a shunting-yard parser (``with`` binds before ``and``, ``and`` before ``or``).
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import narrow, prepare, texts
from velum.llm.decontam import _CASE_AND_GAPS as WORD_BYTES

# The phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notices, by the words they are made of.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0", "mozilla public license": "mpl", "eclipse public license": "epl",
    "bsd license": "bsd", "isc license": "isc", "boost software license": "bsl-1.0", "unlicense": "unlicense",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by 4 0": "cc-by-4.0", "cc by sa 4 0": "cc-by-sa-4.0", "cc0": "cc0-1.0", "public domain": "public-domain",
    "all rights reserved": "proprietary", "creative commons attribution": "cc-by", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAGS = ("spdx license identifier", "license expression")
# How freely text under a licence may be used, by the start of its identifier; the longest start counts.
OPENNESS = {"mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "unlicense": 1.0, "cc0": 1.0, "public": 1.0, "zlib": 1.0, "0bsd": 1.0, "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-sa": 0.5, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0}
UNKNOWN = 0.3
EXCEPTION_GAIN = 0.2

# What follows a tag: a sign, and the rest of the line up to a mark that no expression has.
_AFTER_TAG = re.compile(rb"[\"'`)\]]*\s*[:=]\s*[\"']*([^\n\r\"';,<>*]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9.+:_-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def openness(identifier: str) -> float:
    at = max((k for k in OPENNESS if identifier.startswith(k)), key=len, default=None)
    return UNKNOWN if at is None else OPENNESS[at]


def parse(expression: str) -> tuple[list[str], int]:
    """Reverse Polish form of the longest valid expression that ``expression`` (lower case) begins with, and the number
    of tokens used. Text after it is ignored; ([], 0) if there is none."""
    out: list[str] = []
    stack: list[str] = []
    best, used, rest, operand, depth = 0, 0, [], True, 0
    for k, m in enumerate(_TOKEN.finditer(expression)):
        t = m[0].rstrip(".")  # the end of a sentence
        if operand:
            if t == "(":
                stack.append(t)
                depth += 1
            elif t in ("", ")") or t in _BINDS:
                break
            else:
                out.append(t)
                operand = False
        elif t in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == ")" and depth:
            depth -= 1
            while (x := stack.pop()) != "(":
                out.append(x)
        else:
            break
        if not operand and not depth:  # the stack holds one operator of a kind at most
            best, used, rest = len(out), k + 1, stack[::-1]
        if len(t) < len(m[0]):
            break
    return out[:best] + rest, used


def evaluate(polish: list[str]) -> tuple[float, str, set[str]]:
    """How open the expression is (``or``: the better side, ``and``: the worse, ``with``: the licence and a bit), its
    normal form, and its identifiers."""
    stack: list[tuple[float, deque[str], int]] = []
    names: set[str] = set()
    for t in polish:
        if t not in _BINDS:
            stack.append((openness(t), deque((t,)), 9))
            names.add(t)
            continue
        (b, y, yb), (a, x, xb) = stack.pop(), stack.pop()
        binds = _BINDS[t]
        if t == "with":
            names -= {*y} if len(y) == 1 else set()
            value = min(1.0, a + EXCEPTION_GAIN)
        else:
            value = max(a, b) if t == "or" else min(a, b)
        for side, w in ((x, xb), (y, yb)):
            if w < binds:
                side.appendleft("(")
                side.append(")")
        if len(x) >= len(y):  # the shorter side moves, so that long expressions take no square of their length
            x.append(f" {t} ")
            x.extend(y)
        else:
            y.appendleft(f" {t} ")
            y.extendleft(reversed(x))
            x = y
        stack.append((value, x, binds))
    value, form, _ = stack.pop()
    return value, "".join(form), names


def _expressions(raw: bytes, tags: list[int]) -> Iterator[str]:
    """The lower-case texts that follow the words of these numbers; one within the text after an earlier tag is a part of
    that."""
    if not tags:
        return
    inside = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 32
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    read = 0
    for at in ends[tags].tolist():
        if at >= read and (m := _AFTER_TAG.match(raw, at)):
            read = m.end()
            yield m[1].lower().decode("utf-8", "replace")


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for phrase in {**BASE, **NOTICES, **dict.fromkeys(TAGS)}:
            self.automaton.add_word(f" {phrase} ", phrase)
        self.automaton.make_automaton()

    def scan(self, text: str) -> dict:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.translate(WORD_BYTES).split()
        joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
        base, own, spans, scores, expressions, tags = set(), set(), [], [], [], []
        at = before = 0  # places come in the order of their ends
        for end, phrase in self.automaton.iter(joined):
            before, at = before + joined.count(" ", at, end), end
            if phrase in BASE:
                spans.append((before - phrase.count(" ") - 1, phrase))
                base.add(BASE[phrase])
                scores.append(openness(BASE[phrase]))
            elif phrase in NOTICES:
                own.add(NOTICES[phrase])
                scores.append(openness(NOTICES[phrase]))
            else:
                tags.append(before - 1)  # its last word
        for expression in _expressions(raw, tags):
            polish, _ = parse(expression)
            if polish:
                value, form, names = evaluate(polish)
                scores.append(value)
                own |= names
                expressions.append(form)
        places = [s for s, _ in spans]
        return {"n_words": len(words), "n_base": len(spans), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | own)), "score": min(scores, default=0.0), "places": [{"word": s, "phrase": p} for s, p in spans], "expressions": expressions}


RESULT = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,places:array<struct<word:long,phrase:string>>,expressions:array<string>>"


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([*((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))), ("expressions", pa.list_(pa.string()))])
    scanner = Scanner()
    for batch in batches:
        yield pa.array([scanner.scan(t) for t in texts(batch)], kind)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their
    smallest and largest start, null without any), base_labels, labels (those of notices and expressions too; both
    distinct, sorted, joined by commas), score (how open the least open licence found is; 0 if none is found), places,
    expressions (normal form). Null texts count as empty, repeated rows stay, an empty table gives none."""
    prepare(docs.sparkSession)
    d = narrow(docs, doc_id=id_col, text=text_col)
    return d.select("doc_id", F.arrow_udf(_scan, RESULT)("text").alias("s")).select("doc_id", "s.*")
