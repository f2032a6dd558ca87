import random

from pyspark.sql import functions as F

from velum.functions import ranges


def data(n, seed=3):
    rng = random.Random(seed)
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(50)]), k, rng.randrange(-5, 9)) for k in range(n)]


def test_running_totals_of_a_hot_group(spark):
    rows = data(700)
    df = spark.createDataFrame(rows, "g string, t int, place long, x long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranges.running(df, ["g"], ["t", "place"], {"n": (F.sum, F.lit(1)), "s": (F.sum, F.col("x")), "most": (F.max, F.col("x")), "bits": (F.bit_xor, F.col("place"))})
        found = {r.place: (r.n, r.s, r.most, r.bits) for r in got.collect()}
        parts = got.select(F.spark_partition_id().alias("p"), "g").where("g = 'hot'").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in {r[0] for r in rows}:
        n = s = bits = 0
        most = -99
        for _, _, k, x in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            n, s, most, bits = n + 1, s + x, max(most, x), bits ^ k
            assert found[k] == (n, s, most, bits)
    assert parts > 1 and got.columns == ["g", "t", "place", "x", "n", "s", "most", "bits"]


def test_ranks_without_a_task_for_all(spark):
    rows = data(300)
    df = spark.createDataFrame(rows, "g string, t int, range long, before long")
    got = ranges.ranks(df, F.asc_nulls_last("t"), "range")
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    assert [r.range for r in got.orderBy("rank").collect()] == [r[2] for r in order]
    assert [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, 301))
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert ranges.ranks(df.where("false"), "range").count() == 0


def test_blocks_of_dense_numbers(spark):
    df = spark.range(1, 501).select((F.col("id") % 2).alias("g"), F.col("id").alias("d"))
    got = ranges.along(df, ["g"], F.shiftright("d", 4), ["d"], {"s": (F.sum, F.col("d")), "least": (F.min, F.col("d"))})
    assert all(r.s == sum(x for x in range(1, r.d + 1) if x % 2 == r.g) and r.least == (1 if r.g else 2) for r in got.collect())
