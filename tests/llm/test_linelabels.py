import itertools
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from velum.llm import linelabels as L

DOCUMENTS, LABELS = "/root/testdata/sf0.01/documents.parquet", "/root/testdata/sf0.01/labels.parquet"


def base(text):
    """The measures by plain loops."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    marked = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w)


ODD = [None, "", "\n", "\n\n \t\n", "a", "a b c d e f g h a b c d e f g h", "x\nx\nx", "\r\nx\r\n", "é y\x85z\x1c w v", "𝒳 😀\n😀 #", " lead\n lead\nlead", "one " * 25, "a b c d e f g h i " * 3]


def texts(n, seed):
    rng = random.Random(seed)
    return [rng.choice([" ", "  ", "\n"]).join(rng.choice(["of", "the", "a#", "|", "9é", "\n", "a b c d e f g h", "And so it is."]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_base_measures_against_loops(spark):
    field = L.Field(np.zeros(len(L.FEATURES)), 0.0, np.zeros((2, 2)))
    every = ODD + texts(150, 3)
    for batch in (every, every[::-1], every[:1]):
        for t, r in zip(batch, L.described([x or "" for x in batch], field), strict=True):
            got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
            assert got == base(t) and r["n_lines"] == (t or "").count("\n") + 1
    assert L.described([], field) == []


def test_features_are_those_of_the_line_alone_and_its_place():
    every = [t or "" for t in ODD + texts(60, 5)]
    together = L.Lines(every)
    for k, t in enumerate(every):
        alone = L.Lines([t])
        assert (alone.features == together.features[together.starts[k] : together.starts[k + 1]]).all()
    named = lambda t: [{L.FEATURES[x] for x in row if x >= 0} for row in L.Lines([t]).features.tolist()]
    first, second, third = named("Menu | a | b\nIt is so.\nMenu | a | b")
    assert "first" in first and "repeats" not in first and "repeats" in third and "last" in third
    assert "ends_sentence" in second and "begins_capital" in second and "symbols0" in second and "symbol_words3" in first
    bits = L.Lines(["a b\n# 7"]).masks()
    assert [{L.FEATURES[k] for k in range(len(L.FEATURES)) if int(b) >> k & 1} for b in bits] == named("a b\n# 7")


def test_viterbi_against_all_labellings():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 8)
        scores = [rng.randrange(-3, 4) for _ in range(n)]
        field = L.Field(np.zeros(len(L.FEATURES)), 0.0, np.zeros((2, 2)))
        field.start, field.steps = rng.randrange(-2, 3), [[rng.randrange(-2, 3) for _ in range(2)] for _ in range(2)]

        def value(y, scores=scores, field=field):
            return field.start * y[0] + sum(s for s, x in zip(scores, y, strict=True) if x) + sum(field.steps[a][b] for a, b in itertools.pairwise(y))

        best = max(map(value, itertools.product((0, 1), repeat=n)))
        assert value(field.decode(scores)) == best
    assert L.Field(np.zeros(len(L.FEATURES)), 0.0, np.zeros((2, 2))).decode([0, 0, 0]) == [0, 0, 0]
    assert L.Field(np.zeros(len(L.FEATURES)), 0.0, np.zeros((2, 2))).decode([]) == []


def test_the_fit_is_where_the_likelihood_is_greatest():
    """Sums over all labellings: moving any parameter from the fitted ones makes the penalised likelihood smaller."""
    rng = np.random.default_rng(3)
    kinds = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    sequences = [rng.integers(0, 3, rng.integers(1, 6)) for _ in range(40)]
    labels = [((s == 2) | (rng.random(len(s)) < 0.2)).astype(np.int64) for s in sequences]

    def loss(p):
        total = 0.25 * (p**2).sum()
        for s, y in zip(sequences, labels, strict=True):
            def value(z, s=s):
                return p[2] * z[0] + sum(kinds[k] @ p[:2] for k, x in zip(s, z, strict=True) if x) + sum(p[3 + 2 * a + b] for a, b in itertools.pairwise(z))
            total += np.log(sum(np.exp(value(z)) for z in itertools.product((0, 1), repeat=len(s)))) - value(y)
        return total

    w, start, steps = L.fit_chain(kinds, sequences, labels, rounds=600)
    p = np.concatenate((w, [start], steps.ravel()))
    least = loss(p)
    for k in range(len(p)):
        for move in (-0.05, 0.05):
            q = p.copy()
            q[k] += move
            assert loss(q) > least


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(DOCUMENTS), spark.read.parquet(LABELS)
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    found = L.quality(docs, labels.where(learn)).join(labels.where(~learn), "doc_id").where("not base_failed").collect()
    low, good = [r for r in found if r.quality == 0], [r for r in found if r.quality == 1]
    assert len(low) > 5 and sum(not r.kept for r in low) >= 0.9 * len(low)
    assert sum(r.kept for r in good) >= 0.99 * len(good) > 50


def test_query_rows(spark):
    from velum.llm import queries

    rows = queries.op11_quality(spark, "/root/testdata/sf0.001").collect()
    given = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(given[r.doc_id])
        assert r.kept == (not r.base_failed and r.content_share >= 0.5)


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    good = "It is a good day.\nThe sun is up and we go out to the park to see it all from there, as one does."
    rows = [(1, good, 5), (1, good, 5), (2, None, 5), (None, good, 5), (3, "| # |\n" * 40 + "x | y | z\n" * 10, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").selectExpr("*", "1 as line_quality", "'q' as q")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 0), (77, 0)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    found = sorted((r.doc_id or -1, r.n_words, r.kept) for r in L.quality(docs, labels).collect())
    assert found == [(-1, 25, True), (1, 25, True), (1, 25, True), (2, 0, False), (3, 170, False)]
    stay = L.without_low_quality(docs, labels)
    assert stay.columns == docs.columns and stay.count() == 3
    assert L.quality(docs.where("false"), labels).count() == 0
    assert sorted(r.kept for r in L.quality(docs, labels.where("false")).collect()) == [False, False, True, True, True]


def test_very_long_texts_take_linear_time():
    field = L.Field(np.zeros(len(L.FEATURES)), 0.0, np.zeros((2, 2)))
    for text in ("a b\n" * 200_000, "word " * 200_000, "\n" * 500_000, "x" * 2_000_000, "#" * 1_000_000):
        began = time.time()
        L.described([text], field)
        assert time.time() - began < 12
