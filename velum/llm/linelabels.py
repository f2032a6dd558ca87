"""Lines as content or boilerplate by a linear-chain conditional random field, and what that says about a document.

A line is described by yes/no features of its length, its words, symbols, digits, capitals and marks, its ends, its place,
and whether it repeats an earlier line. The field has a weight for each (for boilerplate against content), one for how a
document begins and one for each of the four steps from line to line; Viterbi decoding gives the labels of all lines of a
text together. Weights are whole numbers of 1 / UNIT, so that sums don't depend on their order; content wins ties. A
document is kept if it passes the base rules and its content lines hold a share of KEEP of its word characters or more.

There are no labels of lines, only of documents (quality 0 or 1), so they are made in two steps on a bounded sample of the
labelled rows. A logistic model says which lines are typical of documents of low quality; those lines in such documents
are boilerplate, all other lines content. The field is then fitted to these sequences by its penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.llm.common import fresh, narrow, prepare, texts

#: Base rules: words a document needs, words of a window, and the share of words in repeated windows that fails it.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 0.30
#: Share of word characters in content lines that a kept document has.
KEEP = 0.5
#: Bounds of the fit: labelled rows, lines, and lines of a sequence (longer documents are cut into several).
MAX_ROWS, MAX_LINES, SEQUENCE = 20_000, 100_000, 128
UNIT = 1 << 16
_BUCKETS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Upper ends of the bins of each measure of a line; a last bin has what is above.
BINS = {
    "words": (0, 1, 3, 7, 15, 39),
    "symbols": (0.0, 0.02, 0.05, 0.15),
    "symbol_words": (0.0, 0.1, 0.3),
    "digits": (0.0, 0.05, 0.2),
    "capitals": (0.0, 0.05, 0.2),
    "marks": (0.0, 0.03, 0.1),
    "word_length": (2.0, 4.0, 6.0, 9.0),
}
FLAGS = ("ends_sentence", "begins_capital", "repeats", "first", "last")
FEATURES = [f"{name}{k}" for name, ends in BINS.items() for k in range(len(ends) + 1)] + list(FLAGS)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that are found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    if len(codes) == len(words):
        return 0
    each = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ each[k : k + n]) * _ODD
        mixed ^= mixed >> np.uint64(29)
    if len(np.unique(mixed)) == n:  # windows of different hashes differ
        return 0
    rank, size = np.unique(each, return_inverse=True)[1].astype(np.int64), 1
    if len(codes) > len(np.unique(each)):  # two words of one hash
        numbers = {w: k for k, w in enumerate(codes)}
        rank = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    while size < window:  # ranks of twice as many words, exactly; the last step may overlap
        step = min(size, window - size)
        rank = np.unique(rank[:-step] * len(words) + rank[step:], return_inverse=True)[1]
        size += step
    twice = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window:] -= twice
    return int((np.cumsum(edges) > 0).sum())


class Lines:
    """The lines of one text or more, described all at once. ``features`` has a row of places in FEATURES for each line, one a
    bin measure and -1 for a flag that isn't set."""

    def __init__(self, batch: list[str]):
        every = [t.split("\n") for t in batch]
        self.counts = np.array([len(x) for x in every], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))
        c = np.frombuffer("".join(t + "\n" for t in batch).encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = np.concatenate(([0], np.flatnonzero(c == 10) + 1))[:-1]
        per_line = lambda mask: np.add.reduceat(mask, cut, dtype=np.int64)
        space = (c == 32) | ((c >= 9) & (c <= 13))
        begins = ~space & np.concatenate(([True], space[:-1]))
        small = np.where(c < 128, c, 0).astype(np.uint8)
        symbol, mark = _SYMBOL[small], _MARK[small]
        self.words, self.chars, self.symbols = per_line(begins), per_line(~space), per_line(symbol)
        word = np.cumsum(begins)
        hit = np.zeros(len(c), bool)
        at = np.flatnonzero(symbol)
        hit[at[np.diff(word[at], prepend=0) > 0]] = True
        place = np.arange(len(c))
        last = np.maximum.reduceat(np.where(space, -1, place), cut)
        first = np.minimum.reduceat(np.where(space, len(c), place), cut)
        some, full = self.words > 0, np.maximum(self.chars, 1)
        self.repeats = np.array([x for lines in every for x in _repeats(lines)], bool) & some
        measures = {
            "words": self.words,
            "symbols": self.symbols / full,
            "symbol_words": per_line(hit) / np.maximum(self.words, 1),
            "digits": per_line((c >= 48) & (c <= 57)) / full,
            "capitals": per_line((c >= 65) & (c <= 90)) / full,
            "marks": per_line(mark) / full,
            "word_length": self.chars / np.maximum(self.words, 1),
        }
        ends_sentence, begins_capital = np.zeros(len(cut), bool), np.zeros(len(cut), bool)
        ends_sentence[some] = _STOP[small[last[some]]]
        begins_capital[some] = _CAPITAL[small[first[some]]]
        line = np.arange(len(cut))
        flags = (ends_sentence, begins_capital, self.repeats, np.isin(line, self.starts[:-1]), np.isin(line, self.starts[1:] - 1))
        columns, base = [], 0
        for name, ends in BINS.items():
            columns.append(base + np.searchsorted(ends, measures[name], side="left"))
            base += len(ends) + 1
        for flag in flags:
            columns.append(np.where(flag, base, -1))
            base += 1
        self.features = np.stack(columns, axis=1).astype(np.int16)

    def masks(self) -> np.ndarray:
        """The features of each line as the bits of a number."""
        bits = np.where(self.features >= 0, np.uint64(1) << np.maximum(self.features, 0).astype(np.uint64), np.uint64(0))
        return np.bitwise_or.reduce(bits, axis=1)


def _class_of(chars: str) -> np.ndarray:
    out = np.zeros(128, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _MARK, _STOP, _CAPITAL = (_class_of(x) for x in ("#*$%&|<>", ".,;:!?", ".!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _repeats(lines: list[str]) -> list[bool]:
    if len(set(lines)) == len(lines):
        return [False] * len(lines)
    seen: set[str] = set()
    return [line in seen or seen.add(line) is not None for line in lines]


class Field:
    """Weights as whole numbers of 1 / UNIT: of the features and the start for boilerplate, ``steps[a][b]`` from label a
    to b (0 content, 1 boilerplate)."""

    def __init__(self, weights: np.ndarray, start: float, steps: np.ndarray):
        whole = lambda x: np.rint(np.asarray(x) * UNIT).astype(np.int64)
        self.weights, self.start, self.steps = whole(weights), int(whole(start)), whole(steps).tolist()

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.concatenate((self.weights, [0]))[features].sum(axis=1)

    def decode(self, scores: list[int]) -> list[int]:
        """The best labels of a text's lines: on ties of a step and of the end content."""
        (cc, cb), (bc, bb) = self.steps
        content, boiler, back = 0, 0, []
        for k, s in enumerate(scores):
            if k:
                to_c, to_b = bc + boiler > cc + content, bb + boiler > cb + content
                back.append((to_c, to_b))
                content, boiler = (bc + boiler if to_c else cc + content), (bb + boiler if to_b else cb + content) + s
            else:
                boiler = self.start + s
        label = int(boiler > content)
        out = [label]
        for to_c, to_b in reversed(back):
            label = int(to_b if label else to_c)
            out.append(label)
        return out[::-1] if scores else []


def fit_logistic(bits: np.ndarray, n: np.ndarray, low: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last one constant) of the penalised logistic model by Newton steps: ``low`` of ``n`` lines with these
    ``bits`` are in documents of low quality."""
    x = np.hstack((bits, np.ones((len(bits), 1))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (low - n * p) - ridge * w)
        w = w + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(kinds: np.ndarray, sequences: list[np.ndarray], labels: list[np.ndarray], ridge: float = 0.5, rounds: int = 150, rate: float = 0.15) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, start and steps of the penalised likelihood of ``labels``. ``kinds`` has a row of bits for each kind of
    line, ``sequences`` the kinds of their lines. Forward and backward sums run over all sequences at once; gradient steps
    of adaptive size."""
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    longest = len(sequences[order[0]])
    at = [np.array([sequences[k][t] for k in order if len(sequences[k]) > t]) for t in range(longest)]
    y = [np.array([labels[k][t] for k in order if len(sequences[k]) > t]) for t in range(longest)]
    n_features = kinds.shape[1]
    told = np.zeros(len(kinds))
    told_steps = np.zeros((2, 2))
    for t in range(longest):
        told += np.bincount(at[t], y[t], len(kinds))
        if t:
            np.add.at(told_steps, (y[t - 1][: len(y[t])], y[t]), 1)
    parameters = np.zeros(n_features + 5)
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for r in range(1, rounds + 1):
        e = np.exp(np.clip(kinds @ parameters[:n_features], -30, 30))
        step = np.exp(np.clip(parameters[n_features + 1 :], -30, 30)).reshape(2, 2)
        forward = []
        for t in range(longest):
            a = np.ones((len(at[0]), 2)) if t == 0 else forward[-1][: len(at[t])] @ step
            if t == 0:
                a[:, 1] = np.exp(np.clip(parameters[n_features], -30, 30))
            a[:, 1] *= e[at[t]]
            forward.append(a / a.sum(axis=1, keepdims=True))
        expected, pairs = np.zeros(len(kinds)), np.zeros((2, 2))
        backward = np.zeros((0, 2))
        for t in range(longest - 1, -1, -1):
            grown = np.ones((len(at[t]), 2))
            if len(backward):
                coming = backward.copy()
                coming[:, 1] *= e[at[t + 1]]
                both = forward[t][: len(coming)][:, :, None] * step[None] * coming[:, None, :]
                pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                grown[: len(coming)] = coming @ step.T
            grown /= grown.sum(axis=1, keepdims=True)
            backward = grown
            marginal = forward[t] * backward
            p = marginal[:, 1] / marginal.sum(axis=1)
            expected += np.bincount(at[t], p, len(kinds))
        start = float((p - y[0]).sum())
        gradient = np.concatenate((kinds.T @ (expected - told), [start], (pairs - told_steps).ravel())) + ridge * parameters
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        parameters = parameters - rate * (1 - r / (rounds + 1)) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return parameters[:n_features], float(parameters[n_features]), parameters[n_features + 1 :].reshape(2, 2)


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Rows (doc_id, low, part, masks) of at most about ``max_rows`` labelled documents' sequences."""
    graded = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("low"))
    share = min(1.0, max_rows / max(1, graded.count()))
    chosen = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)) < int(share * _BUCKETS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = Lines(texts(batch.column("text")))
            masks = lines.masks().view(np.int64)
            ids, low = batch.column("doc_id").to_pylist(), batch.column("low").to_pylist()
            rows = [(i, x, k, masks[s : min(s + SEQUENCE, b)].tolist()) for i, x, a, b in zip(ids, low, lines.starts[:-1], lines.starts[1:], strict=True) for k, s in enumerate(range(a, b, SEQUENCE))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "low", "part", "masks"])

    joined = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "low", "text")  # max_rows rows of 12 bytes
    return joined.mapInArrow(read, "doc_id long, low int, part int, masks array<long>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_lines: int = MAX_LINES) -> Field:
    """The field of a sample of ``labels`` (doc_id, quality): at most about ``max_rows`` documents and ``max_lines`` lines,
    chosen by hashes. Ids labelled twice are of low quality only if every label says so; null labels don't count. Without
    labels of both kinds all lines are content."""
    prepare(docs.sparkSession)
    d = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    sample = _sample(d, narrow(labels, doc_id="doc_id", quality="quality"), max_rows).checkpoint()
    n_lines = sample.agg(F.sum(F.size("masks"))).first()[0] or 0
    share = min(1.0, max_lines / max(1, n_lines))
    few = sample.where(F.pmod(F.xxhash64("doc_id", "part"), F.lit(_BUCKETS)) < int(share * _BUCKETS))
    rows = sorted((r.doc_id, r.part, r.low, r.masks) for r in few.collect())
    none = Field(np.zeros(len(FEATURES)), 0.0, np.zeros((2, 2)))
    if len({low for _, _, low, _ in rows}) < 2:
        return none
    masks = np.concatenate([np.array(x, np.int64) for *_, x in rows]).view(np.uint64)
    kinds, kind = np.unique(masks, return_inverse=True)
    bits = ((kinds[:, None] >> np.arange(len(FEATURES), dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    low = np.repeat([x[2] for x in rows], [len(x[3]) for x in rows])
    w = fit_logistic(bits, np.bincount(kind, minlength=len(kinds)).astype(float), np.bincount(kind, low, len(kinds)))
    typical = (bits @ w[:-1] + w[-1] > 0)[kind]
    label = ((low > 0) & typical).astype(np.int64)
    cuts = np.cumsum([len(x[3]) for x in rows])[:-1]
    return Field(*fit_chain(bits, np.split(kind, cuts), np.split(label, cuts)))


RESULT = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,boilerplate:array<int>,n_lines:long,content_share:double,kept:boolean>"


def described(batch: list[str], field: Field, keep: float = KEEP) -> list[dict]:
    """What RESULT has, for each text."""
    if not batch:
        return []
    lines = Lines(batch)
    scores = field.scores(lines.features).tolist()
    total = lambda x: np.add.reduceat(x, lines.starts[:-1], dtype=np.int64).tolist()
    words, chars, symbols, repeats = total(lines.words), total(lines.chars), total(lines.symbols), total(lines.repeats)
    out = []
    for k, text in enumerate(batch):
        a, b = int(lines.starts[k]), int(lines.starts[k + 1])
        label = field.decode(scores[a:b])
        boiler = [i for i, x in enumerate(label) if x]
        lost = int(lines.chars[a:b][boiler].sum()) if boiler else 0
        again = repeated_words(text.encode("utf-8", "surrogatepass").split()) if words[k] > WINDOW else 0
        failed = words[k] < LEAST_WORDS or 100 * again > round(100 * MOST_REPEATED) * words[k]
        share = (chars[k] - lost) / chars[k] if chars[k] else 0.0
        out.append({
            "n_words": words[k], "word_chars": chars[k], "n_symbols": symbols[k], "n_dup_lines": repeats[k], "n_repeat_words": again,
            "base_failed": failed, "boilerplate": boiler, "n_lines": b - a, "content_share": share, "kept": not failed and share >= keep,
        })
    return out


def labeller(docs: DataFrame, field: Field, keep: float = KEEP) -> Column:
    """A function of a text column that gives RESULT."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(field)  # a weight a feature
    kind = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("boilerplate", pa.list_(pa.int32())), ("n_lines", pa.int64()), ("content_share", pa.float64()), ("kept", pa.bool_())])

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(described(texts(batch), sent.value, keep), kind)

    return F.arrow_udf(label, RESULT)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base measures (n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words), base_failed, boilerplate (numbers of these lines from 0), n_lines, content_share, kept.

    A null text has no words and fails the base rules like an empty one; a text is one line at least. Repeated rows stay;
    an empty table gives none. Extra columns are ignored. Without labels of both kinds the base rules alone decide."""
    field = train(docs, labels, id_col, text_col)
    d = narrow(docs, doc_id=id_col, text=text_col)
    return d.select("doc_id", labeller(d, field, keep)("text").alias("q")).select("doc_id", "q.*")


def without_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. Nulls, repeats and empty tables as in ``quality``."""
    field = train(docs, labels, id_col, text_col)
    c = fresh(docs, "line_quality")
    return docs.withColumn(c, labeller(docs, field, keep)(F.col(text_col))).where(F.col(f"{c}.kept")).drop(c)


__all__ = ["Field", "Lines", "described", "fit_chain", "fit_logistic", "labeller", "quality", "repeated_words", "train", "without_low_quality"]
