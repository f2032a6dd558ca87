import json
import time

import pytest
from pyspark.sql import functions as F

from velum.functions import events
from velum.functions.regex import given, with_offsets
from velum.operators import detect, dictionary, smart
from velum.operators.dictionary import Mapping
from velum.plans import outbound


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r


def names(spark, text, variant="live", **more):
    return [(f.name, f.value) for f in one(spark, text, lambda t: detect.findings(t, variant=variant, **more))]


@pytest.mark.parametrize("text,live", [
    ("at 192.168.1.5 now", [("Private IP", "192.168.1.5")]),
    ("at 93.184.216.34 or 8.8.8.8", [("Public IP", "93.184.216.34")]),
    ("mac 00:1a:2B:3c:4d:5e", [("MAC Address", "00:1a:2B:3c:4d:5e")]),
    ("12 Main Street here", [("Street Address", "12 Main Street")]),
    ("at -12.34567, -98.76543.", [("GPS Coordinates", "12.34567, -98.76543")]),
    ("on 01/02/1990", []),
    ("born 01/02/1990", [("Date (possible DOB)", "01/02/1990")]),
    ("ein 12-3456789", [("EIN / Tax ID", "12-3456789")]),
    ("in /home/bob/x", [("Home Path", "/home/bob")]),
    ("bob@box:$ ls", []),
    ("bob@box$ ls", [("Shell Prompt", "bob@box$ ")]),
    ("git@github.com:me/repo.git", [("Git Remote", "git@github.com:me/repo.git")]),
    ("x USER=bob y", [("Env Variable", "USER=bob")]),
    ("abc", []),
])
def test_live(spark, text, live):
    assert names(spark, text) == live


def test_lib_keeps_no_overlaps_and_live_no_repeats(spark):
    text = "passport A12345678 at 10.0.0.1 and 10.0.0.1, 1.0.0.1 zip 12345"
    assert names(spark, text, "lib") == [("US Passport Number", "A12345678"), ("Private IP Address", "10.0.0.1"), ("Private IP Address", "10.0.0.1"), ("US Zip Code", "12345")]
    assert names(spark, text) == [("Private IP", "10.0.0.1"), ("Public IP", "1.0.0.1")]
    assert names(spark, "10.0.0.1 here", identity=smart.Identity(hostnames=(("10.0.0.1", "h"),))) == []
    assert one(spark, None, detect.findings) == []


def test_proper_nouns(spark):
    text = "Bob saw Acme Corp and the Bob. Then Zed; Monday Morning"
    got = [f.value for f in one(spark, text, lambda t: detect.proper_nouns(t, ["zed"]))]
    assert got == ["Acme Corp", "Bob", "Morning"]


def test_fakes(spark):
    text = "10.1.1.1 C:\\Users\\bob /Users/al git@github.com:me/r.git HOME=/x 10.1.1.1"
    r = one(spark, text, detect.stage())
    assert r.text == "192.0.2.1 C:\\Users\\user /Users/user git@github.com:/example/r.git HOME=REDACTED 192.0.2.1"
    assert [e.pattern for e in r.events] == ["Env Variable", "Git Remote", "Home Path", "Home Path", "Private IP"] and r.events[0].category == "auto-detect"
    assert one(spark, "10.1.1.1", lambda t: detect.to_mappings(detect.findings(t)))[0].substitute == "192.0.2.1"


CONFIG = outbound.Config(smart.Identity(names=(("John", "Alex", "first"),)), (Mapping("Alex", "Kim"), Mapping("acme", "zeta")))


def test_stages_run_in_order(spark):
    df = spark.createDataFrame([(1, "John at acme, 10.1.1.1, 123-45-6789"), (2, "plain"), (3, None)], "id int, text string")
    r = {x.id: x.result for x in outbound.substitute_all(df, CONFIG).collect()}
    assert r[1].text == "Kim at zeta, 192.0.2.1, [REDACTED-SSN]" and [e.category for e in r[1].events] == ["name", "general", "general", "secret", "auto-detect"]
    assert (r[2].text, r[2].modified, r[3].text) == ("plain", False, None)
    counts = outbound.stage_counts(df, CONFIG).first()
    assert (counts.n_smart, counts.n_explicit, counts.n_secrets, counts.n_warnings) == (1, 2, 1, 1)
    off = outbound.substitute_all(df, outbound.Config()).first().result
    assert off.text.endswith("123-45-6789") and not off.modified


def test_bodies_of_any_shape(spark):
    body = {"id": "acme", "m": [{"text": "acme", "key": "acme"}, "acme x", "a", 1, None, [["John"]]], "n": {"deep": {"v": "no"}}}
    rows = [(1, json.dumps(body)), (2, "acme raw"), (3, '"acme"'), (4, None), (5, "{}"), (6, "[]")]
    got = {r.id: r.body_out for r in outbound.substitute_bodies(spark.createDataFrame(rows, "id int, body string"), CONFIG, "body").collect()}
    assert json.loads(got[1]) == {"id": "acme", "m": [{"text": "zeta", "key": "acme"}, "zeta x", "a", 1, None, [["Kim"]]], "n": {"deep": {"v": "no"}}}
    assert (got[2], got[3], got[4], got[5], got[6]) == ("zeta raw", '"acme"', None, "{}", "[]")


def test_walk_of_known_types(spark):
    df = spark.sql("select named_struct('token', 'abc', 't', 'abc', 'a', array(named_struct('x', 'abc', 'n', 1)), 'm', map('k', 'abc', 'key', 'abc')) s")
    got = df.select(outbound.walk(F.col("s"), df.schema["s"].dataType, F.upper).alias("s")).first().s
    assert got.asDict(True) == {"token": "abc", "t": "ABC", "a": [{"x": "ABC", "n": 1}], "m": {"k": "ABC", "key": "abc"}}


def test_markup_and_urls(spark):
    assert one(spark, "<p id='abc'>abc</p> abc <b> a </b>", lambda t: outbound.rewrite_markup(t, F.upper)) == "<p id='abc'>ABC</p> ABC <b> a </b>"
    urls = {"https://x.org/a.JS?v=1": True, "https://x.org/analytics/p": True, "https://sentry.io": True, "https://x.org/a.json": False, "https://x.org/logs": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.s for r in df.select("u", outbound.skipped_url(F.col("u")).alias("s")).collect()} == urls


def test_long_texts_with_many_matches(spark):
    n = 20_000
    df = spark.range(1).select(F.expr(f"repeat('10.0.0.1 ', {n})").alias("t"))
    began = time.monotonic()
    places = df.select(with_offsets(F.col("t"), r"1(?=0)").alias("p")).select(F.size("p").alias("n"), F.expr("p[size(p) - 1].start").alias("last")).first()
    assert tuple(places) == (n, 9 * (n - 1))
    assert df.select(F.size(detect.findings(F.col("t"), variant="lib")).alias("n")).first().n == n
    assert df.select(F.size(detect.findings(F.col("t"))).alias("n")).first().n == 1
    assert df.select(F.size(dictionary.diff(F.col("t"), [Mapping("0", "z")])).alias("n")).first().n > 3 * n
    assert time.monotonic() - began < 120


def test_many_findings_by_pieces(spark):
    text = " ".join(f"user{k}@mail{k % 7}.example 10.0.{k // 200}.{k % 200} home/user{k}" for k in range(2500))
    docs = spark.createDataFrame([(1, text), (2, "mail a@b.example from 10.0.0.1"), (3, None), (4, "x")], "id int, text string").selectExpr("*", "1 as found", "2 as done")
    by_pieces = {r.id: r.result for r in detect.redacted(docs, many=5).collect()}
    folded = {r.id: r.result for r in detect.redacted(docs, many=1 << 30).collect()}
    assert by_pieces == folded and len(by_pieces[1].events) > 2000 and by_pieces[3].text is None
    assert detect.redacted(docs).columns == [*docs.columns, "result"]


def test_patterns_are_skipped_by_literals_they_need(spark):
    sql = detect._patterns("live", ())
    assert "(contains(t, ':') OR contains(t, '-')) AND rlike" in sql and "in_context" not in sql
    texts = ["mac 00-1A-2b-3C-4d-5E", "born 04/12/1988", "on 04/12/1988", "x 12-3456789", "in C:\\Users\\ann", "HTTPS://github.com/a/b", "GIT@github.com:a/b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: [f.name for f in r.f] for r in rows.select("id", detect.findings(F.col("text")).alias("f")).collect()}
    assert got == {0: ["MAC Address"], 1: ["Date (possible DOB)"], 2: [], 3: ["EIN / Tax ID"], 4: ["Home Path"], 5: ["Git Remote"], 6: ["Git Remote"]}


def test_patterns_run_only_where_a_part_of_a_match_is(spark):
    for variant, patterns in detect.CATALOGUES.items():
        sql = detect._patterns(variant, ())
        assert sql.startswith("transform(array(regexp_replace(t,") and sql.count("rlike(t,") < len(patterns)
        assert all(p.needs or p.digits for p in patterns)
    numbers = ["10.0.0.1", "1.2.3.4,5.6.7.8", "255.255.255.255.1", "v1.2.3.4x 9.8.7.65", "12\nMain  Street", "5\x0bOld Mill Road.", "77 main st", "12-3456789", "x12-3456789 112-3456789", "1990-01-02/03", "01/02/1990-12/31/2001", "12345", "12345-6789", "1 2345 67890", "A12345678", "B1234567 C12345678901234", "-12.34567,\n\t-98.76543", "1.23456, 7.8", "١٢٣٤٥ 12345"]
    others = ["00:1A:2b:3C:4d:5E-1", "00-1A-2b-3C-4d-5E", "0:0:0:0:0:ffff:1:2 f::1", "a.b@c-d$ x@y@z# \n", "bob@box:$ ls", "q@r> q@r>x -._@.-_%\t", "/home/a /Home/b C:\\Users\\c /Users/", "git@GitHub.com:a/b HTTPS://gitlab.com/c", "home=x USER=y", "born zip", "", "é5.6.7.8é"]
    texts = [*numbers, *others, " ".join(numbers + others), "".join(numbers + others), "zip born ".join(others + numbers), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").persist()
    old_prompt = r"[a-zA-Z0-9._-]+@[a-zA-Z0-9._-]+[:$#%>]\s"
    for variant, patterns in detect.CATALOGUES.items():
        for p in patterns:
            plain = F.regexp_extract_all("t", F.lit(old_prompt if p.name == "Shell Prompt" else p.pattern), F.lit(0))
            plain = F.when((F.length("t") >= 5) & (F.lit(not p.in_context) | F.col("t").rlike(detect.CONTEXT[variant])), plain).otherwise(F.array().cast("array<string>"))
            if p.exclude:
                plain = F.filter(plain, lambda v: ~v.rlike(f"^(?:{p.exclude})\\z"))  # noqa: B023
            found = given(F.col("t"), f"transform(filter({detect._patterns(variant, ())}, f -> f.name = '{p.name}'), f -> f.value)")
            found = F.when(F.length("t") >= 5, found).otherwise(F.array().cast("array<string>"))
            got = rows.select("id", plain.alias("plain"), found.alias("found")).collect()
            assert all(r.plain == r.found for r in got), (variant, p.name)
            assert any(r.found for r in got) or p.name == "URL with Username", p.name
    rows.unpersist()


def test_rows_without_findings_and_repeated_rows_of_redaction(spark):
    rows = [(1, "at 10.0.0.1 and 10.0.0.12, 10.0.0.1"), (1, "at 10.0.0.1 and 10.0.0.12, 10.0.0.1"), (None, "mac 00:1A:2b:3C:4d:5E"), (2, "1-2.3,4/5 6 a:b c-d e@f"), (3, ""), (4, None), (5, "dev@box7$ ls")]
    df = spark.createDataFrame(rows, "id int, text string")
    r = events.only_changed(events.apply(df, "text", [detect.stage()], "r"), "r")
    got = sorted((x.id or 0, x.r.text, len(x.r.events)) for x in r.collect())
    assert got == [(0, "mac 00:00:00:00:00:00", 1)] + [(1, "at 192.0.2.1 and 192.0.2.1, 192.0.2.1", 2)] * 2 + [(5, "user@host:$ ls", 1)]
    lib = df.select("id", F.explode(detect.findings(F.col("text"), variant="lib")).alias("f")).select("id", "f.value", F.col("f.index").alias("at"))
    assert sorted((x.id or 0, x.value, x.at) for x in lib.collect()) == [(0, "00:1A:2b:3C:4d:5E", 4)] + sorted([(1, "10.0.0.1", 3), (1, "10.0.0.12", 16), (1, "10.0.0.1", 27)] * 2) + [(5, "dev@box7$ ", 0)]
    assert "Exchange" not in r._jdf.queryExecution().executedPlan().toString()
