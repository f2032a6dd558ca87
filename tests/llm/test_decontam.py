import hashlib
import random
import re
import time

from velum.llm import decontam


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    out = {}
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(window, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        got.add(str(item) if item is not None else "")
        out[i] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out


def longest(docs, items, window):
    """The longest verbatim match of each document: words, start, item, start in the item."""
    out = {}
    for i, t in docs:
        w, found = words(t), []
        for item, x in items:
            v = words(x)
            for s in range(len(v)):
                for p in range(len(w)):
                    if w[p] != v[s] or (s and p and w[p - 1] == v[s - 1]):
                        continue
                    n = 0
                    while p + n < len(w) and s + n < len(v) and w[p + n] == v[s + n]:
                        n += 1
                    if n >= min(window, len(v)):
                        found.append((-n, p, str(item), s))
        n, p, item, s = min(found, default=(None,) * 4)
        out[i] = (-n, p, item, s) if n else (None,) * 4
    return out


def case(seed):
    rng = random.Random(seed)
    pick = lambda n: [rng.choice(["the", "Of", "é", "x9", "blau", "zu"]) for _ in range(n)]
    items = [(k, " ".join(pick(rng.choice([0, 1, 3, 8, 12, 25])))) for k in range(2, 14)] + [(99, None), (100, "!!"), (5, "Blau the zu zu zu é")]
    docs = []
    for i in range(40):
        w = pick(rng.choice([0, 2, 30, 80]))
        if rng.random() < 0.6:
            src = words(rng.choice(items)[1])
            w[len(w) // 2 : len(w) // 2] = src
        docs.append((i, rng.choice([" ", ", ", "\n--"]).join(w)))
    return [*docs, (200, None), (201, ""), (202, "THE of! " * 3000)], items


def test_against_brute_force(spark):
    for seed in range(3):
        docs, items = case(seed)
        items = [x for x in items if len(words(x[1])) != 1] if seed else items
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as scanned", "2 as n_words").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        for window, block in ((10, 1 << 20), (4, 60)):
            rows = {r.doc_id: tuple(r)[1:] for r in decontam.contamination(d, b, window=window, block_bytes=block).collect()}
            want = brute(docs, items, window)
            assert {i: x[:5] for i, x in rows.items()} == want
            assert {i: x[5:] for i, x in rows.items()} == longest(docs, items, window)
            kept = decontam.without_benchmark(d, b, window=window, block_bytes=block)
            assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[-1]}


def test_longest_matches(spark):
    item = [f"w{i}" for i in range(30)]
    d = spark.createDataFrame([(1, "x y " + " ".join(item[3:20]) + " z"), (2, " ".join(item)), (3, " ".join(item[:9]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = sorted(tuple(r) for r in decontam.matches(d, b).collect())
    assert got == [(1, "7", 3, 2, 17), (2, "7", 0, 0, 30)]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(d, b).count() == 0
    one = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [tuple(r)[1:4] for r in decontam.contamination(one, b).collect()] == [(2, 0, 0)] * 2


def test_repeated_words_take_their_places_and_no_more():
    items = [(str(k), "la " * 200) for k in range(20)]
    known = decontam.Benchmark(items)
    began = time.time()
    (got,) = known.scan(["la " * 8000])
    assert got["spans"] == [{"start": 0, "end": 8000}] or len(got["spans"]) == 1
    assert len(got["matches"]) == 20 * (8000 - 9 + 190) and max(m["length"] for m in got["matches"]) == 200
    assert time.time() - began < 3
