"""Toxicity by cumulative-link ordinal regression on sparse word features.

Grades: 0 for documents that aren't labelled toxic, 1 for toxic ones, 2 for toxic ones with more of the chosen features
that toxic documents have more often than the median of toxic ones. So the text itself orders the grades.
The model has one weight a word and one threshold a grade, shared in the way of proportional odds:
P(grade > k) = sigmoid(w.x - threshold_k), thresholds in ascending order. Features say which of the chosen words
and word beginnings (four to six characters and a star, so that forms of a word count together) a document has. They
are those whose documents' grades differ most from the others' (chi-square).

Labelled rows may be many, so the model is fitted to a bounded sample of them (``max_rows``, chosen by a hash of the
id); near copies, known by the smallest hash of their five-word shingles, count once, so that one text repeated
doesn't decide about its words. Every document is scored by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import fresh, narrow, prepare, texts
from velum.llm.decontam import words_of

GRADES = 3
#: Bounds of the fit: labelled rows, and words with a weight.
MAX_ROWS, MAX_WORDS = 20_000, 4_096
#: A word needs so many documents of the sample at least, or this share of them, and this chi-square.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_CHI2 = 4, 0.001, 30.0
RIDGE = 0.05
#: A document is rejected if it has a grade above 0 with this probability.
REJECT = 0.5
BEGINNINGS = (4, 5, 6)
_BUCKETS = 1 << 20


def signature(words: list[bytes], shingle: int = 5) -> int:
    """The smallest hash of the shingles: near copies mostly share it."""
    one = xxhash.xxh64_intdigest
    return min((one(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))), default=0)


def features_of(words: Iterable[bytes]) -> set[str]:
    """Distinct words, and beginnings of longer ones."""
    out = {w.decode("utf-8", "surrogatepass") for w in words}
    return out.union(*({w[:k] + "*" for w in out if len(w) > k} for k in BEGINNINGS))


class Model:
    """Features with their weights, and the thresholds between grades."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, text: str) -> list[float]:
        """P(grade > k) for each k."""
        found = self.weights.keys() & features_of(set(words_of(text)))
        x = sum(sorted(self.weights[w] for w in found))
        return (1 / (1 + np.exp(np.clip(self.thresholds - x, -500, 500)))).tolist()


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int = GRADES, ridge: float = RIDGE, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the penalised likelihood, by gradient steps of adaptive size. ``rows`` has
    the feature numbers of each document; grades run from 0. Half a document is added to each grade for the start."""
    n = len(rows)
    share = np.cumsum([np.sum(grades == k) + 0.5 for k in range(n_grades)])[:-1] / (n + 0.5 * n_grades)
    start = np.log(share / (1 - share))
    # thresholds as the first one and the logarithms of the steps to the next
    parameters = np.concatenate((np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    if not n:
        return np.zeros(n_features), start
    at = np.repeat(np.arange(n), [len(r) for r in rows])
    feature = np.concatenate(rows) if n else np.zeros(0, np.int64)
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for t in range(1, rounds + 1):
        w, steps = parameters[:n_features], np.exp(parameters[n_features + 1 :])
        thresholds = parameters[n_features] + np.concatenate(([0], np.cumsum(steps)))
        x = np.bincount(at, w[feature], n)
        below = np.concatenate((np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(thresholds - x[:, None], -30, 30))), np.ones((n, 1))), axis=1)
        slope = below * (1 - below)
        index = np.arange(n)
        p = np.maximum(below[index, grades + 1] - below[index, grades], 1e-12)
        upper, lower = slope[index, grades + 1] / p, slope[index, grades] / p
        dx = upper - lower  # of the negative log-likelihood by x
        gradient = np.zeros_like(parameters)
        gradient[:n_features] = np.bincount(feature, dx[at], n_features) + ridge * w
        by_threshold = np.zeros(n_grades + 1)
        np.add.at(by_threshold, grades + 1, -upper)
        np.add.at(by_threshold, grades, lower)
        inner = by_threshold[1:n_grades]
        gradient[n_features] = inner.sum()
        gradient[n_features + 1 :] = np.cumsum(inner[::-1])[::-1][1:] * steps
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        parameters = parameters - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return parameters[:n_features], parameters[n_features] + np.concatenate(([0], np.cumsum(np.exp(parameters[n_features + 1 :]))))


def by_severity(rows: list[np.ndarray], toxic: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Grades of documents that are toxic (1) or not (0): 2 for toxic ones with more ``worse`` features than the median."""
    n = np.array([int(worse[own].sum()) for own in rows], np.int64)
    return np.where((toxic > 0) & (n > np.median(n[toxic > 0])), 2, toxic)


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(grade, signature, words) of at most about ``max_rows`` labelled documents, near copies of equal grade once.
    Grade is 1 for all toxic ones here."""
    graded = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("grade"))
    n = graded.count()
    part = min(1.0, max_rows / max(1, n))
    chosen = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)) < int(part * _BUCKETS))

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [words_of(t) for t in texts(batch)]
            rows = [{"signature": signature(w) - (1 << 63), "words": sorted(features_of(w))} for w in found]
            yield pa.array(rows, pa.struct([("signature", pa.int64()), ("words", pa.list_(pa.string()))]))

    joined = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")  # max_rows rows of 12 bytes
    read_ = joined.select("doc_id", "grade", F.arrow_udf(read, "struct<signature:long,words:array<string>>")("text").alias("d"))
    # of copies the one with the smallest id, and of rows that repeat an id the first in order: the same on every run
    return read_.groupBy("grade", "d.signature").agg(F.min(F.struct("doc_id", "d.words")).alias("first")).select("grade", "signature", "first.words")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    """Fit to a sample of ``labels`` (doc_id, toxic). Ids labelled twice are toxic if one label says so; null labels
    don't count. Without labels no word has a weight and nothing is rejected."""
    prepare(docs.sparkSession)
    sample = _sample(narrow(docs, doc_id=id_col, text=text_col), narrow(labels, doc_id="doc_id", toxic="toxic"), max_rows).checkpoint()
    of_grade = {r.grade: r.n for r in sample.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    n, toxic = sum(of_grade.values()), sum(k for g, k in of_grade.items() if g)
    if not toxic or toxic == n:
        none: dict[str, float] = {}
        return Model(none, fit_ordinal([], np.zeros(0, np.int64), 0)[1] if not n else fit_ordinal([np.zeros(0, np.int64)] * n, np.repeat(list(of_grade), list(of_grade.values())), 0)[1])
    counts = sample.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("toxic"))
    rate = toxic / n
    chi2 = (F.col("toxic") - F.col("n") * rate) ** 2 / (F.col("n") * rate * (1 - rate)) * n / F.greatest(n - F.col("n"), F.lit(1))
    chosen = counts.where(F.col("n") >= max(LEAST_DOCUMENTS, LEAST_SHARE * n)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "word").limit(max_words)
    found = chosen.collect()
    words = [r.word for r in found]
    worse = np.array([r.toxic > r.n * rate for r in found], bool)
    place = {w: k for k, w in enumerate(words)}
    few = F.array_intersect("words", F.lit(words) if words else F.array().cast("array<string>"))
    table = sample.select("grade", "signature", few.alias("words")).toArrow().sort_by([("grade", "ascending"), ("signature", "ascending")])
    rows = [np.array([place[w] for w in own], np.int64) for own in table.column("words").to_pylist()]
    grades = table.column("grade").to_numpy().astype(np.int64)
    w, thresholds = fit_ordinal(rows, by_severity(rows, grades, worse), len(words))
    return Model({x: float(y) for x, y in zip(words, w, strict=True)}, thresholds)


RESULT = "struct<above:array<double>,severity:double,grade:int>"


def scorer(docs: DataFrame, model: Model) -> Column:
    """A function of a text column: P(grade > k), expected severity, and the median grade."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)  # at most max_words words

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("above", pa.list_(pa.float64())), ("severity", pa.float64()), ("grade", pa.int32())])
        for batch in batches:
            found = [sent.value.above(t) for t in texts(batch)]
            yield pa.array([{"above": p, "severity": sum(p), "grade": sum(x >= REJECT for x in p)} for p in found], kind)

    return F.arrow_udf(score, RESULT)


def severities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, grade (predicted), severity (expected), p_toxic (of a grade above 0), toxic
    (whether that is at least REJECT). Null and empty texts have no words and get the severity of a text without any
    chosen word; repeated rows stay; an empty table gives none."""
    model = train(docs, labels, id_col, text_col, max_rows)
    d = narrow(docs, doc_id=id_col, text=text_col)
    found = d.select("doc_id", scorer(d, model)("text").alias("s"))
    return found.select("doc_id", "s.grade", "s.severity", F.col("s.above")[0].alias("p_toxic"), (F.col("s.above")[0] >= REJECT).alias("toxic"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted grade is 0. Null and empty texts stay unless a text without any
    chosen word is graded higher; repeated rows have one fate; an empty table gives none; without labels all stay."""
    model = train(docs, labels, id_col, text_col, max_rows)
    c = fresh(docs, "severity")
    return docs.withColumn(c, scorer(docs, model)(F.col(text_col))).where(F.col(f"{c}.grade") == 0).drop(c)
