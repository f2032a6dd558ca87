import json
import random

import pytest
from pyspark.sql import functions as F

from velum.functions import structure
from velum.operators import reconcile


def spelled(value, rng):
    """A JSON text of ``value``, with keys, spaces, numbers and escapes as they come."""
    gap = lambda: rng.choice(["", " ", "\n\t"])
    if isinstance(value, dict):
        items = list(value.items())
        rng.shuffle(items)
        return "{" + gap() + ",".join(f"{spelled(k, rng)}{gap()}:{gap()}{spelled(v, rng)}" for k, v in items) + gap() + "}"
    if isinstance(value, list):
        return "[" + ",".join(gap() + spelled(v, rng) + gap() for v in value) + "]"
    if isinstance(value, str):
        return '"' + "".join(rng.choice([json.dumps(c)[1:-1], f"\\u{ord(c):04x}"]) for c in value) + '"'
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    return rng.choice([str(value), f"{value}.0", f"{value}e0"]) if isinstance(value, int) else rng.choice([repr(value), f"{value}0"])


def anything(rng, depth=4):
    if depth and rng.random() < 0.6:
        if rng.random() < 0.5:
            return {"".join(rng.choice('ab"\\é1-') for _ in range(rng.randrange(3))) + str(k): anything(rng, depth - 1) for k in range(rng.randrange(4))}
        return [anything(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, "", "a 1.0 e", 'q"\\\n', rng.randrange(-9, 9), 0.5, -2.25, 10**18])


def test_json_forms_are_equal_where_the_values_are(spark):
    rng = random.Random(8)
    values = [anything(rng) for _ in range(150)]
    rows = [(k, spelled(v, rng)) for k, v in enumerate(values) for _ in range(3)]
    df = spark.createDataFrame(rows, "k int, t string").select("k", structure.json_form(F.col("t")).alias("f"))
    forms = {}
    for r in df.collect():
        forms.setdefault(json.dumps(values[r.k], sort_keys=True), set()).add(r.f)
    assert all(len(f) == 1 for f in forms.values())
    assert len({f for x in forms.values() for f in x}) == len(forms)


@pytest.mark.parametrize("text,want", [
    (None, None), ("", ""), ("{bad", "{bad"), ('{"b":1,"a":2} x', '{"b":1,"a":2} x'), ("1,2", "1,2"), ("1] , [2", "1] , [2"), ('{"a":1,"a":2}', '{"a":1,"a":2}'), (" null ", "null"), ("-0.0", "0"), ("[1E2,1.10]", "[100,1.1]"),
    ('"\\u0041 1.0"', '"A 1.0"'), ("[ ]", "[]"), ('{"b":{"d":1,"c":[]},"a":-1}', '{"a":-1,"b":{"c":[],"d":1}}'),
])
def test_json_forms(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(structure.json_form(F.col("t")).alias("f")).first().f == want


def test_long_and_deep_texts(spark):
    long_, deep, wide = '"' + "x\\n" * 400_000 + '"', "[" * 3000 + "]" * 3000, "[" + ",".join(str(k) for k in range(50_000)) + "]"
    rows = spark.createDataFrame([(long_,), (deep,), (wide,)], "t string").select("t", structure.json_form(F.col("t")).alias("f")).collect()
    assert all(r.f == r.t for r in rows)


KIND = "struct<m:map<string,map<string,array<map<int,string>>>>,n:int>"


def test_maps_at_any_depth(spark):
    pair = "named_struct('m', map('b', map('y', array(map(1, 'p', 2, 'q')), 'x', array()), 'a', null), 'n', 1)", "named_struct('m', map('a', null, 'b', map('x', array(), 'y', array(map(2, 'q', 1, 'p')))), 'n', 1)"
    other = "named_struct('m', map('a', null, 'b', map('x', array(), 'y', array(map(2, 'q', 1, 'P')))), 'n', 1)"
    of = lambda x: f"cast({x} as {KIND})"
    df = spark.range(1).selectExpr(f"{of(pair[0])} as x", f"{of(pair[1])} as y", f"{of(other)} as z", f"cast(null as {KIND}) as u")
    kind = df.schema["x"].dataType
    same = lambda a, b: reconcile.deep_equal(F.col(a), F.col(b), kind)
    assert tuple(df.select(same("x", "y"), same("x", "z"), same("x", "u"), same("u", "u")).first()) == (True, False, False, True)
    v = spark.range(1).selectExpr("""parse_json('{"b":1,"a":[1.0]}') as x""", """parse_json('{"a":[1],"b":1}') as y""")
    assert v.select(reconcile.deep_equal(F.col("x"), F.col("y"), v.schema["x"].dataType)).first()[0]


def test_merges_of_rows_with_maps(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "id string, m map<string,map<string,int>>, j string")
    a = t(("same", {"p": {"x": 1, "y": 2}, "q": {}}, '{"a":1,"b":2}'), ("gone", {"p": {"x": 1, "y": 2}}, "[1]"), ("both", {"p": {}}, "1"), ("json", {}, '{"a":1}'))
    l = t(("same", {"q": {}, "p": {"y": 2, "x": 1}}, '{"b":2,"a":1.0}'), ("gone", {"p": {"y": 2, "x": 1}}, "[1.0]"), ("both", {"p": {"x": 1}}, "1"), ("json", {}, '{"a":2}'), ("new", {"p": {"a": 1, "b": 2}}, "0"))  # noqa: E741
    r = t(("same", {"q": {}, "p": {"x": 1, "y": 2}}, ' {"a":1,"b":2}'), ("both", {"p": {"x": 2}}, "1"), ("json", {}, '{"a":2.0}'), ("new", {"p": {"b": 2, "a": 1}}, "0.0"))
    got = {x.id: (x.m, x.j) for x in reconcile.merge(a, l, r, ["id"], json=["j"]).collect()}
    assert set(got) == {"same", "both", "json", "new"} and got["same"][1] == '{"a":1,"b":2}' and got["both"][0] == {"p": {"x": 1}} and got["json"][1] == '{"a":2}'
    assert [x.id for x in reconcile.conflicts(a, l, r, ["id"], json=["j"]).collect()] == ["both"]
    assert {x.id for x in reconcile.conflicts(a, l, r, ["id"]).collect()} == {"same", "gone", "both", "json", "new"}  # as plain text j differs
    repeated = reconcile.merge(a.unionByName(a), l.unionByName(l), r, ["id"], json=["j"])
    assert repeated.count() == 4


def test_settings_by_structure(spark):
    t = lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    spellings = '{"a": 1, "b": [2.0]}', '{"b":[2],"a":1}', '{"b":[2],"a":1e0}'
    (row,) = reconcile.merge_settings(*map(t, spellings)).collect()
    assert (row.value, row.conflict) == (spellings[0], False)
    (row,) = reconcile.merge_settings(t("{}"), t(spellings[1]), t(spellings[2])).collect()
    assert (row.value, row.conflict) == (spellings[1], False)


def test_profiles_with_maps_and_flags_of_any_name(spark):
    kind = "id string, extra map<string,string>, emails array<map<string,string>>, enabled map<string,boolean>"
    t = lambda *rows: spark.createDataFrame(list(rows), kind)
    a = t(("p", {"u": "1", "v": "2"}, [{"r": "a", "s": "b"}, {"r": "c", "s": "d"}], {"names": True, "old": True, "gone": None}))
    l = t(("p", {"v": "2", "u": "1"}, [{"s": "b", "r": "a"}, {"r": "L", "s": "d"}], {"names": False, "old": True, "new": True}))  # noqa: E741
    r = t(("p", {"u": "1", "v": "3"}, [{"r": "R", "s": "b"}, {"s": "d", "r": "c"}], {"names": True, "other": False}))
    rows, found = reconcile.merge_profiles(a, l, r)
    (p,) = rows.collect()
    assert p.extra == {"u": "1", "v": "3"} and p.emails == [{"r": "R", "s": "b"}, {"r": "L", "s": "d"}]
    assert p.enabled == {"names": False, "new": True, "other": False} and found.count() == 0
    clash = t(("p", {"u": "9"}, [{"r": "X"}], {"names": None, "old": False}))
    rows, found = reconcile.merge_profiles(a, l, clash)
    assert sorted((x.path.split("].")[1], json.loads(x.local_value), x.remote_value) for x in found.collect()) == [("emails", [{"r": "a", "s": "b"}, {"r": "L", "s": "d"}], '[{"r":"X"}]'), ("enabled.names", False, None)]
    whole = reconcile.merge_profiles(a, l.where("false"), r)[1].collect()
    assert [(x.path, x.local_value) for x in whole] == [("identity.profiles[p]", None)]


def test_several_choices_for_one_path(spark):
    profiles = spark.createDataFrame([("p", "n", 1)], "id string, name string, k int")
    choices = spark.createDataFrame([("identity.profiles[p].name", '"a"'), ("identity.profiles[p].name", '"b"'), ("identity.profiles[p].k", None), ("settings.x", "1"), ("settings.x", "2"), ("mappings[1]", None), ("mappings[1]", '{"id":"1"}')], "path string, value string")
    assert tuple(reconcile.resolve_fields(profiles, choices).first()) == ("p", "b", None)
    assert [tuple(x) for x in reconcile.resolve_settings(spark.createDataFrame([("x", "0")], "key string, value string"), choices).collect()] == [("x", "2")]
    assert [tuple(x) for x in reconcile.resolve(spark.createDataFrame([("1",)], "id string"), choices, "id").collect()] == [("1",)]


def test_merge_sorts_partitions_not_splits(spark):
    sides = [spark.range(40).selectExpr("id", f"map('x', map('y', id % {k})) as m", f"concat('{{\"a\":', id % {k}, '}}') as j") for k in (2, 3, 5)]
    plan = reconcile.merge(*sides, ["id"], json=["j"])._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange") :]


def test_conflicts_sort_partitions_not_splits(spark):
    sides = [spark.range(40).selectExpr("id", f"map('x', map('y', id % {k})) as m") for k in (2, 3, 5)]
    plan = reconcile.conflicts(*sides, ["id"])._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange") :]
