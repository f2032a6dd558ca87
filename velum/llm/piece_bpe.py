"""Exact merge-type piece encoding by backtracking, and decoding.

A sequence of tokens is the one that the merges give exactly if each token stays whole when encoded alone and each pair
of neighbours stays a pair when it is taken apart and merged again. So the text is read from left to right: an
Aho-Corasick automaton has the longest token at each place; if it isn't compatible with the token before, its next
shorter prefix is tried; if none is left, the last token is taken back, and a bit notes that no encoding passes through
that position. Time is linear in practice, and compatible pairs are kept.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import fresh, narrow, prepare, texts
from velum.llm.pieces import SPACE, Kept, Pieces

PAIRS = 200_000


class MergeEncoder:
    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        ids, score = self.pieces.ids, self.pieces.score
        shared = {x for x, n in Counter(score.values()).items() if n > 1}
        tied = {p for p in ids if len(p) > 1 and score[p] in shared}
        self.tied = [p for p in tied if not any(q in p for q in tied if q != p)]  # the shortest: each other has one
        # tokens that merging their characters gives back, and for each its next shorter prefix of that kind
        self.tokens = {p for p in ids if len(p) == 1 or self.merge(p) == [p]}
        self.prefix = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.tokens), None) for p in self.tokens}
        self.automaton = ahocorasick.Automaton()
        for p in self.tokens:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts = Kept(self.encode_part)

    def merge(self, text: str) -> list[str]:
        """The merges themselves: again and again the neighbours whose joint piece has the best score, the leftmost of
        equals."""
        score = self.pieces.score
        n = len(text)
        symbol: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-score[text[i : i + 2]], i, text[i : i + 2]) for i in range(n - 1) if text[i : i + 2] in score]
        heapq.heapify(queue)
        while queue:
            _, i, joint = heapq.heappop(queue)
            j = after[i] if symbol[i] is not None else n
            if j >= n or symbol[i] + symbol[j] != joint:
                continue
            symbol[i], symbol[j], after[i] = joint, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := joint + symbol[after[i]]) in score:
                    heapq.heappush(queue, (-score[x], i, x))
            if before[i] >= 0 and (x := symbol[before[i]] + joint) in score:
                heapq.heappush(queue, (-score[x], before[i], x))
        return [s for s in symbol if s is not None]

    def compatible(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return found

    def backtrack(self, text: str) -> list[str]:
        """The tokens of a text all of whose characters are pieces."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, (token, length) in self.automaton.iter(text):
            longest[end - length + 1] = token  # of one start, longer tokens end later
        failed = bytearray((n >> 3) + 1)  # a bit for each position; set where no encoding passes
        out: list[str] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or self.compatible(last, token)):
                    break
                token = self.prefix[token]
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                token = self.prefix[last]
        return out

    def encode_part(self, part: str) -> tuple[int, ...]:
        """Ids of a part. Characters that are no piece are their bytes; where pieces of equal score (runs of the word
        mark) could meet, the merges are carried out."""
        ids, known = self.pieces.ids, self.pieces.ids
        part = part.replace(" ", SPACE)
        out: list[int] = []
        k = 0
        while k < len(part):
            if part[k] not in known:
                out += self.pieces.fallback(part[k])
                k += 1
                continue
            z = k + 1
            while z < len(part) and part[z] in known:
                z += 1
            run = part[k:z]
            tied = any(t in run for t in self.tied)
            out += map(ids.__getitem__, self.merge(run) if tied else self.backtrack(run))
            k = z
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        parts = self.parts
        ids = list(chain.from_iterable([parts[p] for p in self.pieces.cut(text)]))
        ids.append(self.pieces.end_id)
        return ids


@lru_cache(maxsize=1)
def encoder_of(model: bytes) -> MergeEncoder:
    """One encoder in a worker process, so that tasks that follow each other there share what it has met."""
    return MergeEncoder(model)


def _lists(batch: pa.Array) -> Iterator[list[int] | None]:
    """The lists of an Arrow list array, by way of flat numbers."""
    flat, at = batch.flatten().to_numpy(), 0
    for n in batch.value_lengths().to_pylist():
        yield None if n is None else flat[at : at + n].tolist()
        at += n or 0


def with_ids(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text, the end id last; null texts as empty ones."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)  # a vocabulary file

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(sent.value)
        for batch in batches:
            yield pa.array([encoder.encode(t) for t in texts(batch)], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, F.arrow_udf(encode, "array<int>")(F.col(text_col)))


def with_decoded(docs: DataFrame, model: bytes, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for, as the library decodes them; null for null."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        library = sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        for batch in batches:
            yield pa.array([None if ids is None else library.decode(ids) for ids in _lists(batch)], pa.string())

    return docs.withColumn(decoded_col, F.arrow_udf(decode, "string")(F.col(ids_col)))


def with_round_trip(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Both, in one pass through Python."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)
    both = fresh(docs, "ids_and_decoded")

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, library = encoder_of(sent.value), sentencepiece.SentencePieceProcessor(model_proto=sent.value)
        for batch in batches:
            ids = [encoder.encode(t) for t in texts(batch)]
            columns = [pa.array(ids, pa.list_(pa.int32())), pa.array([library.decode(x) for x in ids], pa.string())]
            yield pa.StructArray.from_arrays(columns, names=["ids", "decoded"])

    made = docs.withColumn(both, F.arrow_udf(encode, "struct<ids:array<int>,decoded:string>")(F.col(text_col)))
    return made.withColumns({ids_col: F.col(f"{both}.ids"), decoded_col: F.col(f"{both}.decoded")}).drop(both)


def round_trip(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens (with the end id), ids_sha256 (of the decimal ids joined by a
    space), decoded_sha256 (of the decoded text). Null and empty texts have the end id only; repeated rows stay; an
    empty table gives none."""
    made = with_round_trip(narrow(docs, doc_id=id_col, text=text_col), model)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
