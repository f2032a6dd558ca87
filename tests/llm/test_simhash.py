import random

import numpy as np
import pytest
import xxhash

from velum.llm import simhash
from velum.llm.common import components


def brute(texts):
    fps = []
    for t in texts:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    return fps


def classes(ids, fps):
    root = list(range(len(ids)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = up(i), up(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[up(i)] = min(least.get(up(i), x), x)
    return [least[up(i)] for i in range(len(ids))]


def test_fingerprints_and_classes_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "Gämma", "d", "ÉTÉ", "x\x0by", "zz"]
    rows = []
    for i in range(120):
        n = rng.choice([0, 1, 2, 3, 4, 30, 200])
        rows.append((i, rng.choice([" ", "\t", "\n "]).join(rng.choice(words) + str(rng.randrange(9)) for _ in range(n))))
    rows += [(200, None), (201, ""), (202, rows[7][1]), (203, rows[9][1] + " end"), (204, "a " * 5000), (205, "a " * 5001)]
    long = [f"w{rng.randrange(500)}" for _ in range(400)]
    for i in range(60):
        w = list(long)
        w[rng.randrange(400)] = "changed"
        rows.append((300 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fingerprint", "2 as fp")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = brute([t for _, t in rows])
    for (i, _), fp, c in zip(rows, fps, classes([i for i, _ in rows], fps), strict=True):
        assert got[i] == (f"{fp:016x}", c)
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert kept == {c for _, c in got.values()}


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_links_against_all_pairs(spark, budget):
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << bit
            fps.add(x)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in [*signed, *signed[:9], None]], "fp long")
    want = {(min(a, b), max(a, b), n) for k, a in enumerate(signed) for b in signed[:k] if (n := ((a ^ b) & (2**64 - 1)).bit_count()) <= budget}
    links = [tuple(r) for r in simhash.hamming_links(df, budget, spanning=False).collect()]
    assert len(links) == len(set(links)) and set(links) == want
    roots = {r.node: r.root for r in components(simhash.hamming_links(df, budget)).collect()}
    assert roots == {r.node: r.root for r in components(spark.createDataFrame([x[:2] for x in want] or [(1, 1)], "u long, v long")).collect()}


def test_chain_star_and_empty_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(7, 7), (1000, 999)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 300)}, 1000: 999}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "one two three four"), (None, "other words are here"), (4, "one two three four"), (4, "one two three four")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
