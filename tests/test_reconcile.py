import json

import pytest
from pyspark.sql import functions as F

from velum.operators import policy, reconcile

# key, ancestor, local, remote, merged, conflict: all cases of presence and change
TABLE = [
    ("l", None, "L", None, "L", False), ("r", None, None, "R", "R", False), ("lr=", None, "X", "X", "X", False),
    ("lr", None, "L", "R", "L", True), ("a", "A", None, None, None, False), ("a r=", "A", None, "A", None, False),
    ("a l=", "A", "A", None, None, False), ("a r", "A", None, "R", "R", True), ("a l", "A", "L", None, "L", True),
    ("===", "A", "A", "A", "A", False), ("l only", "A", "L", "A", "L", False), ("r only", "A", "A", "R", "R", False),
    ("same", "A", "X", "X", "X", False), ("differ", "A", "L", "R", "L", True),
]


def side(spark, k):
    return spark.createDataFrame([(r[0], r[k], None) for r in TABLE if r[k] is not None], "id string, v string, w int")


def test_truth_table(spark):
    sides = [side(spark, k) for k in (1, 2, 3)]
    got = {r.id: r.v for r in reconcile.merge(*sides, ["id"]).collect()}
    assert got == {r[0]: r[4] for r in TABLE if r[4] is not None}
    found = {r.id: r for r in reconcile.conflicts(*sides, ["id"]).collect()}
    assert set(found) == {r[0] for r in TABLE if r[5]}
    assert found["lr"].ancestor_value is None and found["a r"].local_value is None and json.loads(found["differ"].remote_value) == {"v": "R"} and found["lr"].path == "mappings[lr]"


def test_merge_with_itself(spark):
    a, l, r = (side(spark, k) for k in (1, 2, 3))
    assert sorted(reconcile.merge(a, a, r, ["id"]).collect()) == sorted(r.collect())
    assert sorted(reconcile.merge(a, l, l, ["id"]).collect()) == sorted(l.collect()) and reconcile.conflicts(a, l, l, ["id"]).count() == 0


def test_settings(spark):
    t = lambda **k: spark.createDataFrame([(a, json.dumps(b)) for a, b in k.items()], "key string, value string")
    got = {r.key: (json.loads(r.value), r.conflict) for r in reconcile.merge_settings(t(x=1, y=1, customDomains=["gone"]), t(x=2, y=2, customDomains=["b", "a"]), t(x=1, y=3, customDomains=["a", "c"], z=5)).collect()}
    assert got == {"x": (2, False), "y": (2, True), "customDomains": (["b", "a", "c"], False), "z": (5, False)}


@pytest.mark.parametrize("a,l,r,want,conflict", [
    (["a"], ["a"], ["b"], ["b"], False), (["a"], ["c"], ["a"], ["c"], False), (["a", "b"], ["x", "b"], ["a", "y"], ["x", "y"], False),
    (["a"], ["x"], ["y"], ["x"], True), (["a", "b"], ["a"], ["z", "b"], ["z"], False), ([], ["n"], ["m"], ["n"], True), ([], [], [], [], False),
])
def test_arrays_by_position(spark, a, l, r, want, conflict):  # noqa: E741
    df = spark.createDataFrame([(a, l, r)], "a array<string>, l array<string>, r array<string>")
    got = df.select(reconcile.merge_array(F.col("a"), F.col("l"), F.col("r")).alias("m")).first().m
    assert (got.merged, got.conflict) == (want, conflict)


def test_profiles(spark):
    kind = "id string, name string, emails array<string>, enabled struct<names:boolean,phones:boolean>"
    t = lambda *rows: spark.createDataFrame(list(rows), kind)
    a = t(("p", "n", ["a"], (True, True)), ("gone", "n", [], None), ("changed", "n", [], None))
    l = t(("p", "l", ["a", "b"], (False, True)), ("changed", "z", [], None), ("new", "q", [], None))  # noqa: E741
    r = t(("p", "r", ["a", "c"], (True, False)), ("gone", "n", [], None))
    rows, found = reconcile.merge_profiles(a, l, r)
    got = {x.id: x for x in rows.collect()}
    assert set(got) == {"p", "changed", "new"} and got["p"].name == "l" and got["p"].emails == ["a", "b"] and tuple(got["p"].enabled) == (False, False)
    assert sorted(x.path for x in found.collect()) == ["identity.profiles[changed]", "identity.profiles[p].emails", "identity.profiles[p].name"]


def test_resolve_and_crud(spark):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, v string")
    choices = spark.createDataFrame([("mappings[1]", '{"id":"1","v":"new"}'), ("mappings[2]", None), ("mappings[9]", '{"id":"9","v":"add"}'), ("settings.x", "1")], "path string, value string")
    assert sorted(map(tuple, reconcile.resolve(rows, choices, "id").collect())) == [("1", "new"), ("3", "c"), ("9", "add")]
    up = reconcile.upsert(rows, spark.createDataFrame([("3", "z"), ("4", "d")], "id string, v string"), "id")
    assert sorted(map(tuple, reconcile.remove(up, rows.where("id = '1'"), "id").collect())) == [("2", "b"), ("3", "z"), ("4", "d")]


def test_last_writer_and_snapshots(spark):
    k = "id int, v string, m int"
    got = reconcile.last_writer_wins(spark.createDataFrame([(1, "l", 5), (2, "l", 5), (4, "l", 1)], k), spark.createDataFrame([(1, "r", 5), (2, "r", 6), (3, "r", 0)], k), ["id"], "m")
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "l"), (2, "r"), (3, "r"), (4, "l")]
    s = spark.createDataFrame([(1, 5, "g"), (2, 5, "g"), (3, 4, "h"), (4, 1, "g")], "id int, ts int, g string")
    assert [r.id for r in reconcile.prune(s, 2).orderBy("id").collect()] == [1, 2] and reconcile.prune(s, 0).count() == 4
    assert sorted(r.id for r in reconcile.prune(s, 1, ["g"]).collect()) == [2, 3]
    assert sorted((r.id, r.g) for r in reconcile.first_seen(s, "g", "id").collect()) == [(1, "g"), (3, "h")]


def test_policy(spark):
    personal = spark.createDataFrame([("1", "ACME", "x", "c", True, True), ("2", "other", "y", "c", True, False)], "id string, real string, substitute string, category string, case_sensitive boolean, enabled boolean")
    required = spark.createDataFrame([("Acme", "Org", None, None)], "real string, substitute string, category string, case_sensitive boolean")
    got = {r.id: (r.category, r.enabled, r.org_required) for r in policy.overlay(personal, required, "o1").collect()}
    assert got == {"org-o1-Acme": ("org", True, True), "2": ("c", False, False)}
    pair = "array<struct<real:string,substitute:string>>"
    p = spark.createDataFrame([("t", True, [("a", "b")], [("a", "")], None, None, None, "x@y"), ("t", False, None, None, [("u", "v")], None, None, None), ("u", False, None, None, None, None, None, None)], f"team string, active boolean, names {pair}, emails {pair}, usernames {pair}, hostnames {pair}, phones {pair}, catch_all_email string")
    got = {r.team: (r.compliant, r.missing, r.configured) for r in policy.compliance(p, ["name", "email", "username", "domain"], True, ["team"]).collect()}
    assert got == {"t": (False, ["username"], ["name", "email", "domain", "catch-all email"]), "u": (False, ["name", "email", "username", "domain", "catch-all email"], [])}
    code = spark.range(1).select(policy.read_invite(policy.invite_code(F.lit("http://x"), F.lit("o"))).alias("c")).first().c
    assert tuple(code) == ("http://x", "o")
    k = "org_id string, org_name string, version int"
    assert [r.org_id for r in policy.newer_policy(spark.createDataFrame([("a", "n", 2)], k), spark.createDataFrame([("a", "n", 2), ("b", "n", 1), ("c", "", 9)], k)).collect()] == ["b"]
