import math
import random
import re
import zlib

import numpy as np
import pytest

from velum.llm import langid

VOCAB = {"en": ["the", "thing", "and", "with", "other"], "de": ["der", "schön", "und", "größe", "nicht"], "fr": ["le", "être", "ça", "quelle", "pas"]}


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = [(sentence(rng, lang, 30), lang) for lang in VOCAB for _ in range(30)] + [(None, "en"), ("text", None), ("123", "de")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_counts_are_complete(spark, model):
    assert model.languages == ["de", "en", "fr"]


def test_single_and_mixed(model):
    rng = random.Random(4)
    for lang in VOCAB:
        found, explained = model.mixture(sentence(rng, lang, 25))
        assert [x for x, _ in found] == [lang] and explained
    found, _ = model.mixture(sentence(rng, "de", 60) + " " + sentence(rng, "fr", 30))
    assert [x for x, _ in found] == ["de", "fr"] and 0.5 < found[0][1] < 0.8
    assert abs(sum(s for _, s in found) - 1) < 1e-6


def test_predictions_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, 20), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 ... 34", "de"), (903, "und", None), (None, "the other", "en"), (904, "the " * 40000, "en"), (904, "the " * 40000, "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "'x' as mixture", "1 as score")
    got = langid.identify(df).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred == "und") == (r.doc_id in (900, 901, 902)) and 0 <= r.score <= 1
    right = [r.lang_pred == rows[r.doc_id][2] for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert len(right) > 10 and all(right)
    kept = langid.identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) + 4


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(empty).count() == 0
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")).collect()] == ["und"]


def plain_counts(text):
    """Bucket of each trigram whose middle is a letter, one by one."""
    low = "".join((x if len(x := c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    low = re.sub(" +", " ", f" {low} ")
    out = {}
    for a, b, c in zip(low, low[1:], low[2:], strict=False):
        if b != " ":
            h = (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77 + 0x27D4EB2F & 0xFFFFFFFF ^ ord(c) * 0xC2B2AE3D) & 0xFFFFFFFF
            h = ((h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF) >> 17
            out[h] = out.get(h, 0) + 1
    return out


def plain_em(p, counts, share, rounds):
    for _ in range(rounds):
        new = [0.0] * len(share)
        for bucket, n in counts.items():
            mixed = sum(s * p(k, bucket) for k, s in enumerate(share))
            for k, s in enumerate(share):
                new[k] += n * s * p(k, bucket) / mixed
        new = [x / sum(counts.values()) for x in new]
        still = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-4
        share = new
        if still:
            break
    return share, sum(n * math.log(sum(s * p(k, b) for k, s in enumerate(share))) for b, n in counts.items())


def plain_predict(rows):
    """doc_id -> (language, score), all by loops."""
    learned = {}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for b, n in plain_counts(text).items():
                learned.setdefault(lang, {})[b] = learned.get(lang, {}).get(b, 0) + n
            learned.setdefault(lang, {})
    names = sorted(learned)
    totals = {x: sum(c.values()) + 0.1 * langid.BUCKETS for x, c in learned.items()}
    out = {}
    for i, text, _ in rows:
        counts = plain_counts(text)
        if not counts:
            out[i] = ("und", 0.0)
            continue
        p = lambda k, b: (learned[names[k]].get(b, 0) + 0.1) / totals[names[k]]
        total = sum(counts.values())
        cost = langid.PENALTY * math.log(total + 1)
        alone = [sum(n * math.log(p(k, b)) for b, n in counts.items()) for k in range(len(names))]
        best, chosen, shares = max(alone), [alone.index(max(alone))], [1.0]
        while len(chosen) < len(names):
            mixed = {b: sum(s * p(k, b) for k, s in zip(chosen, shares, strict=True)) for b in counts}
            slope = {k: sum(n * p(k, b) / mixed[b] for b, n in counts.items()) / total for k in range(len(names)) if k not in chosen}
            new = max(slope, key=slope.get)
            if total * (slope[new] - 1) <= cost:
                break
            s, fit = plain_em(lambda j, b, at=[*chosen, new]: p(at[j], b), counts, [*[x * 0.95 for x in shares], 0.05], 40)
            if fit - best <= cost:
                break
            best, chosen, shares = fit, [*chosen, new], s
        out[i] = min(((-x, names[k]) for k, x in zip(chosen, shares, strict=True)))[::-1]
        out[i] = (out[i][0], -out[i][1])
    return out


def test_query_against_plain_mixture(spark):
    rng = random.Random(4)
    words = {"aa": ["kala", "mala", "taka", "lama"], "bb": ["griz", "strock", "plint", "zwerg"], "cc": ["ouei", "auio", "ieou"]}
    rows = []
    for i in range(150):
        langs = rng.sample(sorted(words), rng.choice([1, 1, 2]))
        text = " ".join(rng.choice(words[rng.choice(langs)]) for _ in range(rng.randrange(1, 60)))
        rows.append((i, text, langs[0] if i % 7 else None))
    rows += [(900, None, "aa"), (901, "12 !", "bb"), (902, "Kala GRIZ kala", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = plain_predict(rows)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i, (lang, score) in want.items():
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-6, i


def test_the_mixture_decides_what_stays(spark):
    rng = random.Random(6)
    words = {"aa": ["kala", "mala", "taka", "lama"], "bb": ["griz", "strock", "plint", "zwerg"]}
    of = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, of(x, 40), x) for i, x in enumerate(["aa", "bb"] * 60)]
    rows += [(500, of("aa", 60) + " " + of("bb", 20), None), (501, of("aa", 20) + " " + of("bb", 60), None), (502, "".join(chr(rng.randrange(97, 123)) for _ in range(400)), None), (503, None, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as mixture")
    every = {r.doc_id for r in langid.identified(df).collect()}
    assert every == {i for i, _, _ in rows} - {502, 503}
    wanted = langid.identified(df, wanted=["aa"])
    assert wanted.columns == df.columns and {r.doc_id for r in wanted.collect()} == {i for i, _, x in rows if x == "aa" and i < 500} | {500}


def test_a_language_of_half_a_percent(spark):
    rng = np.random.default_rng(4)
    words = {lang: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "qrstuvwx"))}
    say = lambda lang, n: " ".join(rng.choice(words[lang], n))
    model = langid.train(spark.createDataFrame([(say(x, 40_000), x) for x in words], "text string, lang string"))
    found, explained = model.mixture(say("aa", 6000) + " " + say("cc", 30))
    assert [x for x, _ in found] == ["aa", "cc"] and 0.002 < found[1][1] < 0.01 and explained > 0.9
    assert [x for x, _ in model.mixture(say("bb", 50))[0]] == ["bb"]
