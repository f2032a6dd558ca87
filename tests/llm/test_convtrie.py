import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from velum.llm import convtrie


def brute(rows):
    """Nodes of a plain trie; rows are (conv_id, turn, role, text), equal turns only in equal rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])[:h] + t[h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = sum(saved[x] for x in kids.get(k, [])) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **given):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, owner string")
    return sorted((tuple(r) for r in convtrie.trie(df, **given).collect()), key=str)


def talk(n, rng, words="abc", most=9, step=1):
    return [(c * step, t, rng.choice(["user", "assistant"]), rng.choice(words) * rng.randrange(3)) for c in range(n) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("step", [1, 100, 37])
def test_against_a_plain_trie(spark, step):
    rows = talk(160, random.Random(step), step=step)
    assert got(spark, rows) == brute(rows)


def test_nulls_repeats_negative_ids_and_turnless_ones(spark):
    rows = [(0, None, "user", "first"), (0, 0, None, "b"), (0, 1, "user", None), (None, 0, "user", "nobody"), (7, 5, "user", "only"), (7, 5, "user", "only")]
    rows += [(-150, k, "r", "é" * k) for k in range(4)] + [(-100, k, "r", "é" * k) for k in range(7)] + [(205, 0, "r", "gone"), (3 << 40, 1, "r", "far")]
    rows += [(c, 0, "r", "one") for c in range(300, 330)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, rows[3:4]) == []


def test_long_conversations_are_searched_by_rows(spark):
    """Every conversation goes on where the one before ended, so that chains hang in a line."""
    rows = [(c, t, "r", "s" if t < 40 * c else f"{c}") for c in range(12) for t in range(40 * c + 5)]
    rows += [(c, t, "r", "s") for c in (20, 21) for t in range(300)]
    for block in (4, 64):
        assert got(spark, rows, block=block) == brute(rows)


def test_copies_end_together(spark):
    rows = [(c, t, "r", "same") for c in range(0, 300_000, 1000) for t in range(7)] + [(c, 0, "r", "x") for c in range(1, 5)]
    assert got(spark, rows) == brute(rows)


def test_running_totals_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "_CUT", 2)
    rows = talk(40, random.Random(5), words="ab", most=30)
    assert got(spark, rows) == brute(rows)


def test_a_plan_without_one_task_for_all(spark):
    df = spark.createDataFrame(talk(30, random.Random(2)), "conv_id long, turn long, role string, text string")
    assert "SinglePartition" not in convtrie.trie(df)._jdf.queryExecution().toString()


def test_search_and_doubling(spark):
    chains = spark.createDataFrame([(0, None, 1)] + [(k, k - 1, 1) for k in range(1, 40)] + [(100 + k, 3, 2) for k in range(5)], "conv_id long, parent long, n long")
    found = {r.conv_id: r.n for r in convtrie.subtree_sums(chains, ["n"]).collect()}
    assert all(found[k] == 40 - k + (10 if k <= 3 else 0) for k in range(40)) and found[104] == 2
    assert convtrie.subtree_sums(chains.where(F.lit(False)), ["n"]).count() == 0


def test_query_against_sql(spark):
    import duckdb

    from velum.llm import queries

    duckdb.sql("CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    expected = duckdb.sql(queries.OP13_SQL)
    found = queries.op13_prefixtrie(spark, "/root/testdata/sf0.01")
    assert sorted(found.columns) == sorted(expected.columns)
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted((tuple(r) for r in expected.select(*found.columns).fetchall()), key=str)
