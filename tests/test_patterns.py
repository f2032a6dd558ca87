import random
import time

import pytest
from pyspark.sql import functions as F

from velum.operators import lookup, patterns
from velum.operators.patterns import Custom, literal_of, literals_of

KIND = "ordinal long, name string, pattern string, redact string, enabled boolean"


@pytest.mark.parametrize("pattern,want", [
    ("EMP-\\d+", "emp-"), ("abc", "abc"), ("a|b", ""), ("(a|b)cd", "cd"), ("(?:abc)?d", "d"), ("x(?:abc)+d", "abc"), ("ab*c", "a"), ("abc{2}d", "abc"), ("abc{0,2}d", "ab"),
    ("\\Qa.b*\\Ec+", "a.b*c"), ("[abc]xyz", "xyz"), ("[a&&[^b]]q]", "q]"), ("(?=look)for", "for"), ("(?<name>key)=", "key"), ("(?i)Ab", "ab"), ("(?x) a b", ""), ("(?ix) a b", ""), ("\\bword\\b", "word"),
    ("\\x41bc", "bc"), ("\\u0041bc", "bc"), ("\\p{L}ab", "ab"), ("\\pLab", "ab"), ("\\0101ab", "ab"), ("a\\.b", "a.b"), ("\\v", ""), ("(a(b(cde)?f)g)", "a"), ("(?i:Key)x", "key"), (".*", ""), ("a+?bcd", "bcd"),
    ("\\k<n>xy", "xy"), ("a{3,}+b", "a"), ("(?<!x)(?<=y)z", "z"), ("\\(a\\)", "(a)"), ("x(?#c)y", "x"), ("", ""),
])
def test_literals(pattern, want):
    got = literal_of(pattern)
    assert got == want or (len(got) == len(want) and got)


def some_pattern(rng, depth=2):
    parts = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.randrange(9)
        if kind < 4:
            parts.append("".join(rng.choice(["a", "b", "C", "-", "\\.", "i", "K"]) for _ in range(rng.randrange(1, 4))))
        elif kind == 4:
            parts.append(rng.choice(["[ab]", "[^a]", "\\d", ".", "\\w", "\\b", "[a[bc]]", "[\\]x]", "\\Qb.\\E", "\\x61", "(?=a)", "(?!z)"]))
        elif depth:
            inner = some_pattern(rng, depth - 1)
            parts.append(rng.choice(["({})", "(?:{})", "(?i:{})", "(?>{})", "(?<n>{})"]).format(inner if rng.random() < 0.7 else inner + "|" + some_pattern(rng, 0)))
        if rng.random() < 0.3 and parts and not parts[-1].endswith(("\\b", "(?=a)", "(?!z)")):
            parts[-1] += rng.choice(["?", "*", "+", "{2}", "{0,1}", "{1,}", "+?", "*+"])
    return rng.choice(["", "", "(?i)"]) + "".join(parts)


def matches_nothing(spark, pattern):
    """Whether it may match an empty place: many such patterns in a row make texts as long as memory allows."""
    if not patterns.compiles(spark, pattern):
        return False
    compiled = spark._jvm.java.util.regex.Pattern.compile(pattern)
    samples = ("", "ab", "C-.1", "i K", "bb.", "za")
    return any(compiled.matcher(t).find() and compiled.matcher(t).replaceAll("") == t for t in samples) or compiled.matcher("").find()


def test_the_same_as_trying_all(spark):
    rng = random.Random(3)
    some = [p for p in dict.fromkeys(some_pattern(rng) for _ in range(500)) if not matches_nothing(spark, p)]
    own = [(k, f"p{k}", p, rng.choice(["[X]", "", "a", "b", "-", "$1\\", "aC"]), rng.choice([True, True, None, False])) for k, p in enumerate(some)]
    own += [(1000, "bad", "([", "x", True), (1001, "none", "", "x", True), (1002, "null", None, "x", True)]
    texts = ["".join(rng.choice("abcC-.iKzx1 İK") for _ in range(rng.randrange(25))) for _ in range(120)] + [None, ""]
    table = spark.createDataFrame(own, KIND)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("chosen", F.lit(1)).repartition(4)
    (every,) = patterns.patterns_of(table)
    assert "bad" not in {p.name for p in every} and len(every) > 150
    for part in (every[:40], every[40:90]):
        names = {p.name for p in part}
        chosen = F.lit(None).cast(patterns._CHOSEN)
        chosen = F.array(*[F.struct(F.lit(p.name).alias("name"), F.lit(p.pattern).alias("pattern"), F.lit(p.redact).alias("redact"), F.lit(patterns.replacement(p.redact)).alias("to")) for p in part])
        want = {r.id: r.r for r in docs.select("id", patterns.redacted(F.col("text"), chosen).alias("r")).collect()}
        for block in (patterns.BLOCK_BYTES, 200):
            got = {r.id: r.result for r in patterns.redact_by_table(docs, table.where(F.col("name").isin(*names)), block_bytes=block).collect()}
            assert all(got[k].text == want[k].text and got[k].events == want[k].events for k in want if texts[k] is not None)
            assert got[len(texts) - 2].text is None


def test_what_replacements_bring_in():
    rules = [Custom("a", "secret", "tok"), Custom("b", "token-1", "x"), Custom("c", "zebra", "y"), Custom("d", "my-to", "?"), Custom("e", "tok", "w")]
    chooser = patterns.Chooser(rules)
    assert [p.name for p in chooser.candidates("a secreten-1")] == ["a", "b", "d", "e"] and chooser.candidates("nothing") == []
    empty = patterns.Chooser([Custom("a", "cut", ""), Custom("b", "ab", "x")])
    assert [p.name for p in empty.candidates("acutb")] == ["a", "b"]


def test_five_thousand_patterns(spark):
    table = spark.range(5000).selectExpr("id as ordinal", "concat('p', id) as name", "if(id % 100 = 3, '(', concat('key-', id, '-[a-z]+')) as pattern", "'[K]' as redact", "true as enabled")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", F.concat("text", F.lit(" key-"), F.col("doc_id").cast("string"), F.lit("-abc")).alias("text")).repartition(4)
    began = time.time()
    r = patterns.redact_by_table(docs, table)
    assert r.where(F.size("result.events") > 0).count() == 4950
    assert time.time() - began < 60


def test_a_hundred_thousand_patterns_are_compiled_in_the_tasks(spark):
    table = spark.range(100_000).selectExpr("id as ordinal", "concat('p', id) as name", "if(id % 100 = 3, '([', concat('key-', id, '[.;]')) as pattern", "'[K]' as redact", "true as enabled")
    began = time.time()
    blocks = list(patterns.patterns_of(table))
    assert sum(map(len, blocks)) == 99_000 and blocks[0][1].literal == "key-1"
    assert time.time() - began < 40  # over two minutes by calls from the driver


@pytest.mark.parametrize("pattern,want", [("[]a]xyz", "xyz"), ("[^]a]xyz", "xyz"), ("[b[]c]]xyz", "xyz"), ("abcd{2}{0,1}ef", "abc"), ("(?:a+{0,1}[bc])", ""), ("(?:uvw)*{2}xy", "xy")])
def test_literals_beside_odd_classes_and_counts(pattern, want):
    assert literal_of(pattern) == want


@pytest.mark.parametrize("pattern,want", [
    ("acct-12[.;]", ["acct-12.", "acct-12;"]), ("[aB]c[\\]d]", ["ac]", "acd", "bc]", "bcd"]), ("a|b", []), ("(?x)ab", []), ("[a-c]xy", ["xy"]), ("[^a]xy", ["xy"]), ("[a&&b]xy", ["xy"]), ("[abcde]xy", ["xy"]),
    ("[ab]?xy", ["xy"]), ("[ab]{0,2}xy", ["xy"]), ("x[ab]+c", ["xa", "xb"]), ("[ab][cd][ef][gh]", ["ceg", "ceh", "cfg", "cfh", "deg", "deh", "dfg", "dfh"]), ("x" * 40, ["x" * 32]), (".*", []),
])
def test_small_classes_are_spelled_out(pattern, want):
    assert literals_of(pattern) == want


def test_windows_have_all_literals(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abc-1\u00e9\U0001F600") for _ in range(n))
    literals = sorted({some(rng.randrange(1, 8)) for _ in range(300)} | {some(lookup.LONGEST)})
    texts = [some(rng.randrange(30)) for _ in range(500)] + ["", literals[-1] * 2]
    by_hash = dict(zip(lookup.hashes(literals).tolist(), literals, strict=True))
    assert len(by_hash) == len(literals)
    known = lookup.filter_of(spark.createDataFrame([(x, h) for h, x in by_hash.items()], "x string, h long"))
    assert known.lengths == tuple(sorted({len(x) for x in literals}))
    own, found = known.found(texts)
    got = {(t, by_hash.get(h)) for t, h in zip(own.tolist(), found.view("int64").tolist(), strict=True)}
    want = {(k, x) for k, t in enumerate(texts) for x in literals if x in t}
    assert want <= got and len(got) < 1.05 * len(want) + 20
    sent = spark.sparkContext.broadcast(known)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "key long, text string")
    pairs = {(r.key, by_hash.get(r.h)) for r in lookup.windows(frame, sent).collect()}
    assert want <= pairs <= got


def test_a_table_of_many_blocks_is_one_pass(spark, monkeypatch):
    """Each block of patterns was a pass over all texts, which were written between them; now they are written once."""
    table = spark.range(3000).selectExpr("id as ordinal", "concat('p', id) as name", "concat('key-', id, '[.;]') as pattern", "concat('[K', id, ']') as redact", "true as enabled")
    docs = spark.range(2000).selectExpr("id", "concat('key-', id, '; KEY-', id, '. key-', id + 2000, '.') as text")
    written, plain = [], type(docs).checkpoint
    monkeypatch.setattr(type(docs), "checkpoint", lambda self, *a, **k: written.append(self.columns) or plain(self, *a, **k))
    got = {r.id: r.result for r in patterns.redact_by_table(docs, table, block_bytes=1000).collect()}
    assert len([c for c in written if "result" in c]) == 1
    assert all(r.text == f"[K{k}] KEY-{k}. " + (f"[K{k + 2000}]" if k < 1000 else f"key-{k + 2000}.") for k, r in got.items()) and len(got) == 2000
    assert [e.pattern for e in got[5].events] == ["p2005", "p5"]


@pytest.mark.parametrize("block", [patterns.BLOCK_BYTES, 40])
def test_tables_of_any_size_give_the_same(spark, block):
    """What replacements bring in, equal rows, rows without an order or a name, texts that are equal or missing."""
    rules = [(1, "a", "secret", "tok", True), (2, "b", "token-1", "x", None), (2, None, "zebra", None, True), (3, "d", "my-to", "?", True), (4, "e", "tok", "w", True), (5, "f", "o", "oo", True), (5, "f", "o", "oo", True),
             (None, "g", "first", "secre", True), (6, "h", "(", "x", True), (7, "i", "q", "[z]", False), (8, "j", "\\d{3}", "", True), (9, "k", "(?i)ed]", "$1", True)]
    docs = spark.createDataFrame([(1, "a secreten-1"), (2, "nothing"), (3, "o"), (4, "firstt"), (5, "zebra q 123"), (6, None), (7, "o"), (8, "my-secret")], "id int, text string")
    got = {r.id: r.result for r in patterns.redact_by_table(docs, spark.createDataFrame(rules, KIND), block_bytes=block).collect()}
    texts = {k: r.text for k, r in got.items()}
    assert texts == {1: "a x", 2: "noooothing", 3: "oooo", 4: "w", 5: "[REDACT$1 q [REDACT$1", 6: None, 7: "oooo", 8: "?k"}
    assert [e.pattern for e in got[1].events] == ["b", "a"] and [e.pattern for e in got[3].events] == ["f"] * 3 and got[6].events == []
