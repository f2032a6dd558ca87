import hashlib
import math
import random

import numpy as np

from velum.llm import centroids


def brute(rows, count=8, rounds=10, size=64):
    """Lloyd's rounds with Python's whole numbers only."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:count]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (distance(v, c[j]), j))
    for _ in range(rounds):
        of = [[] for _ in c]
        for _, v in kept:
            of[nearest(v)].append(v)
        c = [[sum(x) // len(own) for x in zip(*own, strict=True)] if own else old for own, old in zip(of, c, strict=True)]
    found = [(i, nearest(v), distance(v, c[nearest(v)])) for i, v in kept]
    inertia = [sum(d for _, j, d in found if j == k) for k in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c]
    long_ = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, long_(d), long_(inertia[j]), long_(sum(inertia)), digest[j]) for i, j, d in found), key=str)


SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int"


def got(spark, rows):
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in centroids.clusters(df).collect()), key=str)


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_against_whole_numbers(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.1) + (i % 5) * 0.02 for _ in range(64)]) for i in range(300)]
    rows += [(400, None), (401, [0.1] * 63), (402, [0.1] * 65), (403, [0.1] * 63 + [None]), (404, [0.1] * 63 + [math.nan]), (405, [0.1] * 63 + [-math.inf]), (406, [])]
    rows += [(7, rows[7][1])] * 3 + [(None, rows[9][1])]
    rows = as_float(rows)
    assert got(spark, rows) == brute(rows)


def test_ties_take_the_smaller_number(spark):
    rng = random.Random(1)
    rows = as_float([(i, [rng.choice([0.0, 1 / 1024, 2 / 1024]) if k < 3 else 0.0 for k in range(64)]) for i in range(120)])
    assert got(spark, rows) == brute(rows)


def test_few_equal_and_no_vectors(spark):
    few = as_float([(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.5] * 64)])
    assert got(spark, few) == brute(few)
    equal = as_float([(i, [0.25] * 64) for i in range(30)])
    assert got(spark, equal) == brute(equal) and {r[1] for r in got(spark, equal)} == {0}
    assert got(spark, []) == [] and got(spark, [(1, None)]) == []


def test_numbers_too_large_for_float32_and_longs(spark):
    rng = random.Random(2)
    rows = as_float([(i, [rng.choice([1, -1]) * 10 ** rng.uniform(-3, 38) if i % 7 == 0 else rng.gauss(0, 1) for _ in range(64)]) for i in range(60)])
    assert got(spark, rows) == brute(rows)


def test_intervals_hold_the_exact_values():
    """What the screening leaves out is never nearest, also where float32 alone would be wrong."""
    rng = np.random.default_rng(6)
    wrong = 0
    for spread in (1, 40, 3000, 1 << 22):
        base = rng.integers(-(1 << 23), 1 << 23, 64)
        c = [[int(x) for x in base + rng.integers(-spread, spread + 1, 64)] for _ in range(8)]
        x = base + rng.integers(-spread, spread + 1, (500, 64))
        made = centroids.Centroids(c)
        exact = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
        possible = made.candidates(x.astype(np.float64))
        assert possible[np.arange(500), exact.argmin(axis=1)].all()
        cluster, distance = made.assign(x.astype(np.float64))
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        rough = np.square(np.array(c, np.float32)).sum(axis=1) - 2 * (x.astype(np.float32) @ np.array(c, np.float32).T)
        wrong += int((rough.argmin(axis=1) != exact.argmin(axis=1)).sum())
    assert wrong > 100  # the test has cases that need the intervals


def test_query_against_sql(spark):
    import duckdb

    from velum.llm import queries

    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    expected = duckdb.sql(queries.OP12_SQL)
    found = queries.op12_centroids(spark, "/root/testdata/sf0.001")
    assert sorted(found.columns) == sorted(expected.columns)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in expected.select(*found.columns).fetchall())
