"""Language identification as a mixture: which languages a document holds, and how much of each.

Model: counts of letter trigrams (lower case, runs of other characters as one gap) by language, in a fixed number of
hash buckets, over every training document. Prediction: expectation-maximisation finds the proportions of the
languages that best explain a document's trigrams; languages are added, whichever the likelihood asks for most, for as
long as the log-likelihood, less a penalty for each language, grows, however small their share. The prediction is the
largest share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import fresh, narrow, prepare, texts

BUCKETS = 1 << 15
#: What another language has to gain in log-likelihood, in multiples of log(trigrams).
PENALTY = 3.0
UNKNOWN = "und"
#: Languages that a model can hold: it is sent to all tasks, 256 kB a language.
MAX_LANGUAGES = 256
#: Share that the wanted languages have to have in a document, where it is a filter.
LEAST = 0.5


@cache
def letters() -> np.ndarray:
    """For each code point: the code point of its lower-case letter, or 32."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def trigrams(text: str) -> np.ndarray:
    """The bucket of each trigram whose middle is a letter; empty if the text has no letter."""
    c = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    gap = c == 32
    c = c[~gap | ~np.concatenate(([False], gap[:-1]))]
    h = c[:-2] * np.uint32(0x9E3779B1) ^ (c[1:-1] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) ^ c[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17))[c[1:-1] != 32]


class Model:
    """Log-probabilities of the buckets by language. Languages in alphabetical order."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.1):
        self.languages = languages
        smoothed = counts.astype(np.float64) + smoothing
        self.p = np.ascontiguousarray((smoothed / smoothed.sum(axis=1, keepdims=True)).T) if languages else np.zeros((BUCKETS, 0))

    @staticmethod
    def _em(p: np.ndarray, n: np.ndarray, rounds: int, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Proportions of the columns of p that explain the counts n, and the log-likelihood."""
        share = np.full(p.shape[1], 1 / p.shape[1]) if start is None else start
        total = n.sum()
        for _ in range(rounds):
            mixed = p @ share
            new = share * (p.T @ (n / mixed)) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def mixture(self, text: str, penalty: float = PENALTY) -> tuple[list[tuple[str, float]], float]:
        """The languages chosen with their shares, largest first, and the share of the text that they explain better
        than noise, which is one more component of the mixture with every bucket alike. No letter or no language
        learned: ([], 0)."""
        grams = trigrams(text)
        if not len(grams) or not self.languages:
            return [], 0.0
        bucket, n = np.unique(grams, return_counts=True)
        p, n = self.p[bucket], n.astype(np.float64)
        cost = penalty * np.log(len(grams) + 1)
        # alone, the language of the best likelihood; then, one at a time, the one that the likelihood asks for most
        alone = n @ np.log(p)
        chosen, best = np.array([int(np.argmax(alone))]), float(alone.max())
        shares = np.ones(1)
        while len(chosen) < p.shape[1]:
            slope = p.T @ (n / (p[:, chosen] @ shares)) / len(grams)
            slope[chosen] = 0
            new = int(np.argmax(slope))
            if len(grams) * (slope[new] - 1) <= cost:  # the likelihood is concave: it can't grow by more than that
                break
            more = np.append(chosen, new)
            s, fit = self._em(p[:, more], n, 40, np.append(shares * 0.95, 0.05))
            if fit - best <= cost:
                break
            chosen, shares, best = more, s, fit
        found = sorted(zip((self.languages[i] for i in chosen), shares.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        noisy = np.column_stack((p[:, chosen], np.full(len(n), 1 / BUCKETS)))
        with_noise, _ = self._em(noisy, n, 20, np.append(shares * 0.9, 0.1))
        return found, float(1 - with_noise[-1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            if lang not in found:
                found[lang] = np.zeros(BUCKETS, np.int64)
            bucket, n = np.unique(trigrams(text), return_counts=True)
            found[lang][bucket] += n
    for lang, counts in found.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count every row of ``labelled`` with a language. Counts are added up in the tasks before the shuffle; a model of
    32,768 numbers a language comes to the driver."""
    prepare(labelled.sparkSession)
    if labelled.select(F.col(lang_col).alias("lang")).where("lang is not null").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled: train on those that are wanted")
    rows = narrow(labelled, text=text_col, lang=lang_col).where("lang is not null").mapInArrow(_count, "lang string, bucket int, n long")
    table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = table.column("lang").to_pylist()
    names = sorted(set(langs))
    place = {x: k for k, x in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS), np.int64)
    if langs:
        np.add.at(counts, (np.array([place[x] for x in langs]), table.column("bucket").to_numpy()), table.column("n").to_numpy())
    return Model(names, counts)


RESULT = "struct<lang:string,score:double,explained:double,languages:array<string>,shares:array<double>>"


def predictor(docs: DataFrame, model: Model, penalty: float = PENALTY) -> Callable[[Column], Column]:
    """A function of a text column: lang (the largest share; ``und`` without letters), score (that share), explained
    (the share of the text that isn't noise), languages and shares, largest first."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)  # 32,768 numbers a language

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("explained", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))])
        for batch in batches:
            rows = []
            for text in texts(batch):
                found, explained = sent.value.mixture(text, penalty)
                lang, score = found[0] if found else (UNKNOWN, 0.0)
                rows.append({"lang": lang, "score": min(1.0, max(0.0, score)), "explained": explained, "languages": [x for x, _ in found], "shares": [y for _, y in found]})
            yield pa.array(rows, kind)

    udf = F.arrow_udf(predict, RESULT)
    return lambda text: udf(text)


def held_out(id_column: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, explained, languages, shares. Learns from the
    rows that aren't held out and have a language, and predicts from the text alone. Null texts and texts without a
    letter are ``und`` with score 0. An empty table gives no rows; without labelled rows all is ``und``."""
    d = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = train(d.where(~held_out(F.col("doc_id"))))
    found = d.select("doc_id", predictor(d, model)(F.col("text")).alias("m"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("m.lang").alias("lang_pred"), "m.score", "m.explained", "m.languages", "m.shares")


def identified(docs: DataFrame, wanted: Iterable[str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that are in the ``wanted`` languages (None: any that is learned): these have a
    share of ``least`` or more in the mixture of languages and noise. Null texts and texts without a letter go. Repeated
    rows have one fate; an empty table gives none, and without labelled rows nothing stays."""
    model = train(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    c = fresh(docs, "mixture")
    found = docs.withColumn(c, predictor(docs, model)(F.col(text_col)))
    names = None if wanted is None else [F.lit(x) for x in wanted]
    own = F.lit(1.0) if names is None else F.aggregate(F.zip_with(f"{c}.languages", f"{c}.shares", lambda x, s: F.when(F.array_contains(F.array(*names), x), s).otherwise(0.0)), F.lit(0.0), lambda a, s: a + s)
    return found.where(F.col(f"{c}.explained") * own >= least).drop(c)
