import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from velum.functions.letters import upper_each
from velum.operators import activity, asof, prefixes
from velum.sources import importer


@pytest.mark.parametrize("sent", [prefixes.SENT_PREFIXES, 0])
def test_longest_prefix(spark, sent):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab/é") for _ in range(rng.randrange(n)))
    urls, known = [word(9) for _ in range(300)] + [None, ""], [word(6) for _ in range(25)] + [None, "zz"]
    known = [k for k in known if k != ""]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] * 2, "k1 int, url string").withColumn("n", F.lit("x"))
    domains = spark.createDataFrame([(d,) for d in known * 2], "domain string")
    longest = lambda u: max((d for d in known if d and u is not None and u.startswith(d)), key=len, default=None)
    got = prefixes.longest_prefix(rows, domains, sent=sent)
    assert got.columns == ["k1", "url", "n", "prefix"]
    assert sorted((r.k1, r.prefix or "") for r in got.collect()) == sorted((k, longest(u) or "") for k, u in enumerate(urls) for _ in range(2))
    assert prefixes.under_prefix(rows, domains, sent=sent).count() == 2 * sum(longest(u) is not None for u in urls)
    every = spark.createDataFrame([("",)], "domain string")
    assert prefixes.under_prefix(rows, every, sent=sent).count() == 2 * (len(urls) - 1)
    assert prefixes.under_prefix(rows, domains.where("false"), sent=sent).count() == 0 == prefixes.under_prefix(rows.where("false"), domains, sent=sent).count()


def turned_back(messages, emitted, pairs):
    """One pass over each session, by plain loops."""
    out = []
    for session, seq, text in messages:
        known = {}
        for s, q, original, replaced in sorted((e for e in emitted if e[1] is not None), key=lambda e: e[1]):
            if s == session and q < seq and original and replaced:
                known[replaced.lower()] = original
        rules = [(s, r, c) for r, s, c in pairs if s.lower() in known and r and s]
        rules += [(k, v, False) for k, v in known.items() if k not in {s.lower() for s, _, _ in rules}]
        for s, r, c in sorted(rules, key=lambda p: (-len(p[0]), p[0], p[1])):
            if text is not None:
                text = re.sub(re.escape(s), lambda m, r=r: r, text, flags=0 if c else re.I)
        out.append((session or "-", seq, text))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 6])
def test_reveal_in_order(spark, parts):
    rng = random.Random(parts)
    sessions = ["hot"] * 8 + ["a", None]
    emitted = [(rng.choice(sessions), 2 * k, rng.choice(["", None, "Ann", f"O{k}", "sub1"]), rng.choice(["Sub1", "SUB2", "sub12", "x", ""])) for k in range(300)]
    messages = [(rng.choice(sessions), rng.randrange(600) * 2 + 1, rng.choice([None, "", "sub1 SUB2 Sub12x", "nothing", "X and sub2"])) for k in range(200)]
    pairs = [("Robert", "SUB2", True), ("Zoe", "Ida", False), ("", "x", False)]
    m = spark.createDataFrame(messages, "session string, seq long, text string").withColumn("key", F.lit(1)).withColumn("block", F.lit("b"))
    e = spark.createDataFrame(emitted, "session string, seq long, original string, replaced string")
    p = spark.createDataFrame(pairs, "real string, substitute string, case_sensitive boolean")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = asof.reveal_in_order(m, e, p)
        assert found.columns == [*m.columns, "revealed"]
        assert sorted(((r.session or "-", r.seq, r.revealed) for r in found.collect()), key=str) == turned_back(messages, emitted, pairs)
        assert sorted(((r.session or "-", r.seq, r.revealed) for r in asof.reveal_in_order(m, e).collect()), key=str) == turned_back(messages, emitted, [])
        assert asof.reveal_in_order(m, e.where("false"), p).where("not (revealed <=> text)").count() == 0
        assert asof.reveal_in_order(m.where("false"), e, p).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_what_is_emitted_with_a_message_is_not_before_it(spark):
    m = spark.createDataFrame([("s", 1, "eve"), ("s", 2, "eve")], "session string, seq int, text string")
    e = spark.createDataFrame([("s", 1, "Ann", "EVE")], "session string, seq int, original string, replaced string")
    assert sorted((r.seq, r.revealed) for r in asof.reveal_in_order(m, e).collect()) == [(1, "eve"), (2, "Ann")]


def test_a_hot_tab_is_many_tasks_work(spark):
    rng = random.Random(7)
    rows = [("hot" if k % 3 else f"t{k % 5}", rng.randrange(200), k, rng.random() < 0.1, rng.randrange(4)) for k in range(900)]
    log = spark.createDataFrame(rows, "tab string, ts int, id int, nav boolean, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.tab, r.epoch): r.n for r in activity.badge_counts(log, "tab", "ts", "id", F.col("nav"), F.col("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, epoch = {}, {}
    for tab, _, _, nav, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        epoch[tab] = epoch.get(tab, 0) + nav
        want[tab, epoch[tab]] = want.get((tab, epoch[tab]), 0) + (0 if nav else n)
    assert got == want


def test_passwords_are_numbered_without_one_task(spark):
    lines = spark.createDataFrame([(0, "url,username,password")] + [(k, f"https://h{k}.example,u{k}x,pass{k % 90}") for k in range(1, 400)], "line_no long, line string")
    found = importer.password_rows(lines)
    numbers = {r.real: r.substitute for r in found.where("category = 'password'").collect()}
    assert numbers == {f"pass{k % 90}": f"[REDACTED-PASSWORD-{k}]" for k in range(1, 91)}
    assert "SinglePartition" not in found._jdf.queryExecution().toString()


def test_upper_each_keeps_lengths(spark):
    rows = spark.createDataFrame([("große ŉ ᾀ é",), ("",), (None,)], "t string")
    assert [r.u for r in rows.select(upper_each(F.col("t")).alias("u")).collect()] == ["GROẞE ŉ ᾈ É", "", None]


@pytest.mark.parametrize("query", ["reveal_pairs_session", "reveal_in_order"])
def test_sharp_s_as_in_sql(spark, tmp_path, query):
    rows = [(1, 0, "user", "öße"), (1, 1, "user", "ßa"), (1, 2, "user", "ŉa"), (2, 0, "user", ""), (2, 3, "user", "ab")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = con.execute(entry.oracle_sql()[query])
    names = [d[0] for d in cur.description]
    got = entry.queries()[query](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
