import json
import random

from pyspark.sql import functions as F

from velum.functions import jsontext
from velum.plans import outbound

SKIP = ("id", "key", "model")


def walk(node, change):
    if isinstance(node, dict):
        return {k: v if k in SKIP else walk(v, change) for k, v in node.items()}
    if isinstance(node, list):
        return [walk(v, change) for v in node]
    return change(node) if isinstance(node, str) else node


def anything(rng, depth):
    if depth and rng.random() < 0.7:
        if rng.random() < 0.5:
            return {rng.choice(["id", "key", "a", "b:", 'q"', "é\\", "{x", "n]"]) + rng.choice(["", "", str(k)]): anything(rng, depth - 1) for k in range(rng.randrange(4))}
        return [anything(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 7, -1.5, "", "x", "a:b", '"', "\\", "{[", "}]", "tab\t\n", "é😀", "id", "long text"])


def rows(spark, bodies):
    change = lambda t: F.concat(F.upper(t), F.lit("!"))
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, t string").withColumn("j", jsontext.is_json(F.col("t")))
    p = jsontext.parts(F.col("t"), SKIP)
    df = df.withColumn("p", F.when(F.col("j"), p)).withColumn("s", jsontext.strings(F.col("p")))
    return df.withColumn("o", jsontext.put_together(F.col("p"), F.transform("s", change))).orderBy("k").collect()


def test_strings_of_any_shape(spark):
    rng = random.Random(11)
    values = [anything(rng, 5) for _ in range(250)]
    values = [v for v in values if isinstance(v, dict | list)]
    bodies = [json.dumps(v, indent=rng.choice([None, 1, "\t"]), ensure_ascii=rng.random() < 0.5) for v in values]
    for v, r in zip(values, rows(spark, bodies), strict=True):
        assert r.j and json.loads(r.o) == walk(v, lambda t: t.upper() + "!"), r.t


def test_what_stays_as_it_is_spelled(spark):
    (r,) = rows(spark, [' { "n" : 1.50e+3 , "id" : [ "x" , {"a":"y"} ] , "\\u0069d":"z", "a":[1,"b"], "a" : "c" } '])
    assert r.o == '{"n":1.50e+3,"id":["x",{"a":"y"}],"\\u0069d":"z","a":[1,"B!"],"a":"C!"}'
    same = spark.createDataFrame([(r.t,)], "t string").select(jsontext.put_together(jsontext.parts(F.col("t"), SKIP), F.array(F.lit(None).cast("string"), F.lit("new \"q\"\n")) ).alias("o")).first().o
    assert same == '{"n":1.50e+3,"id":["x",{"a":"y"}],"\\u0069d":"z","a":[1,"b"],"a":"new \\"q\\"\\n"}'


def test_what_is_json(spark):
    yes = ["{}", "[]", "1", "null", '"s"', ' {"a":1,"a":2} ', '[{"a":{"b":1,"b":[]}}]', '{"":"","":0}']
    no = [None, "", "x", "{", '{"a"}', '{"a":1}{"a":2}', '{"a":1,"a":2} x', '{"a":1,"a":}', "[1,]", '{"a":"', "key: value", "{a:1}", '["a":1]']
    assert [r.j for r in rows(spark, yes + no)] == [True] * len(yes) + [False] * len(no)


def test_long_bodies(spark):
    many = json.dumps([{"id": str(k), "text": f"word {k}"} for k in range(8000)])
    one = json.dumps({"text": "a\\n" * 300_000})
    for r in rows(spark, [many, one]):
        assert json.loads(r.o) == walk(json.loads(r.t), lambda t: t.upper() + "!")


def test_bodies_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, '{"a":"acme"}')], "is_json int, body string")
    out = outbound.substitute_bodies(df, outbound.Config(mappings=(outbound.dictionary.Mapping("acme", "zeta"),)), "body")
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert out.columns == ["is_json", "body", "body_out"] and out.first().body_out == '{"a":"zeta"}'
