import math
import random

import numpy as np
import pytest

from velum.llm import toxicity

BAD = ["idiot", "scum", "moron"]


def corpus(seed, n=900):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{int(rng.paretovariate(0.9))}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD).upper() if rng.random() < 0.3 else rng.choice(BAD))
        docs.append((i, " ".join(w)))
        labels.append((i, int(rng.random() < 0.7), int(toxic if rng.random() > 0.03 else not toxic)))
    return docs, labels


def test_the_gradient_finds_the_maximum():
    rng = np.random.default_rng(1)
    n, true = 4000, np.array([2.0, -1.5, 0.0])
    x = rng.random((n, 3)) < 0.4
    u = rng.logistic(size=n) + x @ true
    y = (u > 0.5).astype(int) + (u > 2.0)
    w, t = toxicity.fit_ordinal([np.flatnonzero(r) for r in x], y, 3, ridge=1e-3)
    assert np.abs(w - true).max() < 0.25 and np.abs(t - [0.5, 2.0]).max() < 0.25

    def loss(w, t):
        below = np.concatenate((np.zeros((n, 1)), 1 / (1 + np.exp(-(t - (x @ w)[:, None]))), np.ones((n, 1))), axis=1)
        return -np.log(below[np.arange(n), y + 1] - below[np.arange(n), y]).sum() + 5e-4 * (w @ w)

    best = loss(w, t)
    for d in np.eye(5) * 0.02:
        for sign in (1, -1):
            assert loss(w + sign * d[:3], t + sign * d[3:]) >= best - 1e-3


def test_held_out_documents(spark):
    docs, labels = corpus(2)
    odd = [(5000, None), (5001, ""), (5002, "the IDIOT again"), (5002, "the IDIOT again"), (None, "scum moron"), (5003, "w1 w2 " * 20000), (5004, "w3 " * 5000 + "moron scum")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 as severity", "2 as grade").repartition(4)
    known = [x for x in labels if x[0] % 3]
    lab = spark.createDataFrame([*known, (5001, None, None), (None, 1, 1), known[0]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.severities(d, lab).collect()}
    truth = {i: any(b in t.lower().split() for b in BAD) for i, t in docs}
    unseen = [i for i, _, _ in labels if not i % 3]
    assert all(got[i].toxic == truth[i] for i in unseen)
    assert not got[5000].toxic and not got[5001].toxic and not got[5003].toxic and got[5002].toxic and got[None].toxic and got[5004].toxic
    assert got[5000].severity == got[5001].severity and all(0 <= r.severity <= 2 for r in got.values())
    assert {r.grade for r in got.values()} <= {0, 1, 2}
    kept = toxicity.without_toxic(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.grade == 0}


def test_the_sample_is_bounded_and_copies_count_once(spark):
    docs, labels = corpus(3, 300)
    copy = "special words that repeat in one toxic text only by chance"
    docs += [(1000 + i, copy) for i in range(200)]
    labels += [(1000 + i, 1, 1) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert not toxicity.train(d, lab).weights.keys() & {"special", "chance", "special*"}
    assert toxicity._sample(d, lab, 60).count() < 120


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_too_few_labels(spark, labels):
    d = spark.createDataFrame([(1, "some text"), (2, "more text")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.severities(d, lab).count() == 2
    assert toxicity.severities(d.where("false"), lab).count() == 0


def test_the_model_is_the_same_however_rows_lie(spark):
    docs, labels = corpus(4, 300)
    docs += [(1000 + i, docs[i % 50][1] + f" tail{i}") for i in range(200)]
    labels += [(1000 + i, 1, labels[i % 50][2]) for i in range(200)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = toxicity.train(d.repartition(5), lab), toxicity.train(d.orderBy(d.doc_id.desc()).coalesce(2), lab.repartition(3))
    assert a.weights == b.weights and a.thresholds.tolist() == b.thresholds.tolist()


def test_one_of_many_words_is_enough_whatever_the_quality(spark):
    rng = random.Random(7)
    bad = [f"bad{chr(97 + k)}" for k in range(10)]
    docs, labels = [], []
    for i in range(1500):
        w = [f"w{rng.randrange(5000)}" for _ in range(40)]
        toxic = i % 9 == 0
        if toxic:
            w += rng.sample(bad, rng.choice([1, 1, 2, 4]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(rng.random() < 0.5), int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    held = [(t, toxic) for (_, t), (i, _, toxic) in zip(docs, labels, strict=True) if i % 4 == 0]
    found = [toxic for t, toxic in held if model.above(t)[0] >= toxicity.REJECT]
    assert sum(found) == sum(toxic for _, toxic in held) == len(found)


def test_query_against_plain_steps(spark):
    """Sample, features, chi-square and grades by loops; the fit alone is the operator's, tested above."""
    rng = random.Random(12)
    clean, bad = [f"word{k}" for k in range(60)], ["vile", "filth", "scumbag", "idiotic"]
    rows, labels = [], []
    for i in range(500):
        toxic = rng.random() < 0.3
        words = [rng.choice(clean) for _ in range(rng.randrange(8, 40))] + [rng.choice(bad) for _ in range(rng.randrange(1, 5) if toxic else 0)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    rows += [(600, rows[4][1]), (601, None), (602, "")]
    labels += [(600, 1, labels[0][2]), (601, 0, 0), (4, 1, None), (777, 1, 1)]
    got = {r.doc_id: r for r in toxicity.severities(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}

    text, graded = dict(rows), {}
    for i, _, t in labels:
        if t is not None and i in text:
            graded[i] = max(graded.get(i, 0), t)
    sample = {}
    for i in sorted(graded, reverse=True):
        w = toxicity.words_of(text[i] or "")
        sample[graded[i], toxicity.signature(w) - (1 << 63)] = {x.decode() for x in w} | {x.decode()[:k] + "*" for x in w for k in (4, 5, 6) if len(x) > k}
    keys = sorted(sample)
    n, toxic = len(keys), sum(g for g, _ in keys)
    counts = {}
    for g, s in keys:
        for f in sample[g, s]:
            a = counts.setdefault(f, [0, 0])
            a[0] += 1
            a[1] += g
    rate, chosen = toxic / n, []
    for f, (m, t) in counts.items():
        chi2 = (t - m * rate) ** 2 / (m * rate * (1 - rate)) * n / max(n - m, 1)
        if m >= 4 and chi2 >= 30:
            chosen.append((-chi2, f))
    words = [f for _, f in sorted(chosen)]
    place = {f: k for k, f in enumerate(words)}
    features = [np.array(sorted(place[f] for f in sample[k] if f in place), np.int64) for k in keys]
    worse = {f for f in words if counts[f][1] > counts[f][0] * rate}
    hits = [sum(words[k] in worse for k in own) for own in features]
    median = np.median([h for h, (g, _) in zip(hits, keys, strict=True) if g])
    grades = np.array([2 if g and h > median else g for h, (g, _) in zip(hits, keys, strict=True)])
    w, thresholds = toxicity.fit_ordinal(features, grades, len(words))
    assert words and {len(set(grades.tolist()))} == {3}
    for i, t in rows:
        own = {x.decode() for x in toxicity.words_of(t or "")}
        own |= {x[:k] + "*" for x in own for k in (4, 5, 6) if len(x) > k}
        x = sum(w[place[f]] for f in own if f in place)
        p = [1 / (1 + math.exp(k - x)) for k in thresholds]
        assert abs(got[i].p_toxic - p[0]) < 1e-3 and abs(got[i].severity - sum(p)) < 2e-3
        assert got[i].grade == sum(y >= 0.5 for y in p) or min(abs(y - 0.5) for y in p) < 1e-2
