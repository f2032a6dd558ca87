"""Token counts of unigram vocabularies without the tokens: Viterbi that carries only best score and piece count.

An Aho-Corasick automaton lists the pieces that end at each character, longest first; for each end the best sum of
scores so far and its number of pieces are kept, nothing else. Ties go as in the tokenizer: a candidate replaces
another only if its score is larger, and longer pieces come first. A character that is no piece costs the least score
of the vocabulary less 10 and counts as its bytes. Sums are exact (64-bit); a tokenizer that adds in 32 bits can round
differently once a sum passes 2**24.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.llm.common import narrow, prepare, texts
from velum.llm.pieces import SPACE, Kept, Pieces

UNKNOWN_PENALTY = 10.0


def as_unigram(model: bytes) -> bytes:
    """A merge-type model file as a unigram one: the scores by rank stay, and the placeholder scores of runs of the
    word mark, far below any rank, become one less than the least rank. The tokenizer library reads the result."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    least = min(p.score for p in proto.pieces if p.score > -1e8)
    for p in proto.pieces:
        if p.score <= -1e8:
            p.score = least - 1
    return proto.SerializeToString()


class Counter:
    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.automaton = ahocorasick.Automaton()
        for p, score in self.pieces.score.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.unknown = min(self.pieces.score.values()) - UNKNOWN_PENALTY
        self.parts = Kept(self.count_part)

    def count_part(self, part: str) -> tuple[int, float]:
        part = part.replace(" ", SPACE)
        n = len(part)
        none = float("-inf")
        best, count = [0.0] + [none] * n, [0] * (n + 1)
        single = self.pieces.score
        reached = 0

        def unknown(upto: int) -> None:
            """Characters up to ``upto`` at which no piece ended, and all that are no piece themselves."""
            nonlocal reached
            for end in range(reached + 1, upto + 1):
                c = part[end - 1]
                if c not in single and best[end - 1] + self.unknown > best[end]:
                    best[end] = best[end - 1] + self.unknown
                    count[end] = count[end - 1] + len(c.encode("utf-8", "surrogatepass"))
            reached = upto

        for last, (length, score) in self.automaton.iter(part):
            end = last + 1
            if end - 1 > reached:
                unknown(end - 1)
            s = best[end - length] + score
            if s > best[end]:
                best[end], count[end] = s, count[end - length] + 1
        unknown(n)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        parts = self.parts
        found = [parts[p] for p in self.pieces.cut(text)]
        return sum(n for n, _ in found), sum((s for _, s in found), 0.0)


def token_counts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, score (of the best segmentation). Null and empty texts have none
    and score 0; repeated rows stay; an empty table gives none."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)  # a vocabulary file

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(sent.value)
        for batch in batches:
            found = [counter.count(t) for t in texts(batch)]
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["n_tokens", "score"])

    d = narrow(docs, doc_id=id_col, text=text_col)
    return d.select("doc_id", F.arrow_udf(count, "struct<n_tokens:long,score:double>")("text").alias("c")).select("doc_id", "c.n_tokens", "c.score")
