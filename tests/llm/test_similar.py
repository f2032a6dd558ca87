import itertools
import random
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_pipeline import folder  # noqa: F401  a fixture
from velum.llm import similar
from velum.llm.common import components


def plain(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The ids that stay."""
    sets, up = [plain(t or "") for _, t in rows], list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if 5 * len(a & b) >= 4 * len(a | b):
            i, j = top(i), top(j)
            up[max(i, j)] = min(i, j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(i, least.get(top(k), i))
    return set(least.values())


def test_one_of_each_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a c")]
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 300))]
        for _ in range(8):
            own = [f"x{rng.randrange(10**6)}" if rng.random() < rng.choice([0.01, 0.02, 0.03, 0.08]) else w for w in base]
            rows.append((len(rows), " ".join(own)))
    rows.append((5, rows[40][1] + " more"))
    hot = [f"h{k}" for k in range(120)]
    for _ in range(60):  # copies of a text at about 0.8 of it, at less of each other
        own = list(hot)
        for at in rng.sample(range(120), 2):
            own[at] = f"y{rng.randrange(10**6)}"
        rows.append((len(rows) + 1000, " ".join(own)))
    rows = [(i, t) for i, t in rows if i != 5 or "more" not in (t or "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as least").repartition(5)
    got = similar.one_of_each(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == brute(rows)
    assert similar.one_of_each(df.where("false")).count() == 0


def test_null_and_repeated_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (3, text + " eight"), (3, text), (None, "other words entirely"), (4, text)], "doc_id long, text string")
    got = similar.one_of_each(df)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, text), (0, "other words entirely"), (3, text), (3, text + " eight")]


def test_the_stage_drops_near_copies_at_the_similarity(spark):
    words = [f"w{k}" for k in range(200)]
    near, far = list(words), list(words)
    near[50] = near[120] = "x"
    for k in range(10, 200, 15):
        far[k] = "y"
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((words, near, far))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {0, 2}


def test_stages_that_follow(spark, folder, tmp_path):  # noqa: F811
    path, rows, bench = folder
    text = {r[0]: r[1] for r in rows}
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id not in (1004, 1005, 1006) and not contains(text, 'idiot')")
    left = [(i, t) for i, t in text.items() if i not in (1004, 1005, 1006) and "idiot" not in t]
    corpus_pipeline.near_duplicates(spark, docs, path).write.parquet(f"{tmp_path}/near")
    docs = spark.read.parquet(f"{tmp_path}/near")
    near = {r.doc_id for r in docs.collect()}
    assert near == brute(left) and not {1000, 1001, 1002} & near
    kept = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, path).collect()}
    found = contaminated([(i, text[i]) for i in sorted(near)], bench, 10)
    assert kept == {i for i, x in found.items() if not x[-1]} and 1003 not in kept


def test_large_tries_are_joined_by_subtrees_and_large_groups_by_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(120):  # one family: any two have about 0.75 to 1
        own = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 4)):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    rows += [(500 + k, " ".join(rng.choice(base) for _ in range(40))) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) as key")
    nodes = similar._fingerprints(d).drop("doc_id").checkpoint()
    assert len(similar.orders(0)) == 1 and len(similar.orders(3)) > 5 and {int(np.bitwise_count(m).sum()) for m in similar.orders(3)} == {3}
    monkeypatch.setattr(similar, "ROOM", 3)
    want = brute(rows)
    for group_text in (similar.GROUP_TEXT, 0):
        classes = {k: k for k in (r.key for r in nodes.collect())}

        def top(k):
            while classes[k] != k:
                k = classes[k]
            return k

        for r in similar.links(d, nodes, group_text).collect():
            a, b = top(r.u), top(r.v)
            classes[max(a, b)] = min(a, b)
        least = {}
        for r in d.collect():
            least[top(r.key)] = min(r.doc_id, least.get(top(r.key), r.doc_id))
        assert set(least.values()) == want


def test_leading_shingles_lose_no_link():
    """Sets at LEAST or more share a leading shingle that is among the first ones of one of them, whatever the order."""
    rng = np.random.default_rng(8)
    for _ in range(3000):
        both = rng.integers(0, 1 << 64, rng.integers(1, 60), np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 64, rng.integers(0, 9), np.uint64)))) for _ in range(2))
        often = rng.integers(0, rng.integers(1, 5), 1 << similar._COUNTERS, np.uint8)
        (x, n), (y, m) = similar.leading(a, often), similar.leading(b, often)
        shared = set(x[:n].tolist()) & set(y.tolist()) | set(x.tolist()) & set(y[:m].tolist())
        assert shared or similar.jaccard(a, b) < similar.LEAST
    assert similar.leading(np.zeros(0, np.uint64), often)[0].tolist() == []


def test_texts_of_one_template_are_not_compared_in_pairs(spark):
    rng = random.Random(2)
    common = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    own = lambda n: " ".join(f"o{rng.randrange(10**7)}" for _ in range(n))
    rows = [(k, f"{common} {own(20)}") for k in range(3000)]
    rows += [(3000 + k, rows[k][1] + " " + own(2)) for k in range(10)]  # near copies among them
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    began = time.time()
    found = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    assert all(found[k] == (k - 3000 if k >= 3000 else k) for k in found) and len(found) == 3010
    assert time.time() - began < 90


def test_large_tries_are_joined_without_their_texts(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(k, " ".join(base[:30] + [f"x{k}"] + base[30:]) if k % 2 else " ".join(base[k % 7 :])) for k in range(60)] + [(100, "far away from all of it and more words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    d = docs.selectExpr("doc_id", "text", "xxhash64(text) as key")
    nodes = similar._fingerprints(d).groupBy("key").agg(F.first("heads").alias("heads"), *[F.first(f).alias(f) for f in similar._FP])
    roots = []
    for size in (similar.GROUP_TEXT, 0):
        edges = similar.links(d, nodes, size)
        known = {r.node: r.root for r in components(edges).collect()}
        roots.append(sorted({known.get(r.key, r.key) for r in d.collect()}))
    assert roots[0] == roots[1]


def test_shuffle_files_go_with_their_executions(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: sum(x.startswith("shuffle_") for x in disk.getAllFiles().mkString(" ").replace("/", " ").split())
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = kept(), spark.conf.get(key, None)
    rows = [(k, " ".join(f"w{k // 3 * 9 + j}" for j in range(30))) for k in range(60)]
    c = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    for _ in range(100):  # they are deleted in the background
        if kept() <= before:
            break
        time.sleep(0.1)
    assert kept() <= before and spark.conf.get(key, None) == setting
    assert {r.component_id for r in c.collect()} == set(range(0, 60, 3))
