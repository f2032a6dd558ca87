import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from velum.functions import regex
from velum.operators import dictionary, pieces, smart
from velum.operators.dictionary import Mapping


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r


RULES = [Mapping("Bob", "Max", case_sensitive=True), Mapping("Bob Smith", "Max $1\\", "name"), Mapping("off", "x", enabled=False), Mapping("", "y"), Mapping("a.b", "C")]


def test_longest_first_literal_and_case(spark):
    r = one(spark, "bob smith met Bob, bob, off, a.b and axb", lambda t: dictionary.substitute(t, RULES))
    assert r.text == "Max $1\\ met Max, bob, off, C and axb"
    assert [(e.original, e.replaced, e.category) for e in r.events] == [("bob smith", "Max $1\\", "name"), ("Bob", "Max", "general"), ("a.b", "C", "general")]
    assert one(spark, None, lambda t: dictionary.substitute(t, RULES)).text is None


def test_rules_cascade(spark):
    r = one(spark, "the the", lambda t: dictionary.substitute(t, [Mapping("the", "X"), Mapping("X", "Y")]))
    assert r.text == "Y Y" and len(r.events) == 4


def test_table_rules_do_the_same(spark):
    rows = [(m.real, m.substitute, m.category, m.case_sensitive, m.enabled) for m in RULES]
    table = spark.createDataFrame(rows, "real string, substitute string, category string, case_sensitive boolean, enabled boolean")
    docs = spark.createDataFrame([(1, "bob smith met Bob, bob, off, a.b and axb"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.result for r in dictionary.substitute_by_table(docs, table).collect()}
    assert got[1].text == "Max $1\\ met Max, bob, off, C and axb" and len(got[1].events) == 3 and got[2].text is None and got[3].events == []
    found = {(r.id, r.real) for r in dictionary.scan_by_table(docs, table, "id").collect()}
    assert found == {(1, "Bob"), (1, "Bob Smith"), (1, "a.b")}


def test_reveal_turns_back(spark):
    rules = [Mapping("alice", "zz-1"), Mapping("alice b", "zz-12")]
    r = one(spark, "alice b and alice", lambda t: dictionary.reveal(dictionary.substitute(t, rules)["text"], rules))
    assert r == "alice b and alice"


def test_diff_keeps_overlaps(spark):
    rules = [Mapping("abc", "1"), Mapping("bc", "2")]
    got = [tuple(x) for x in one(spark, "xabcy", lambda t: dictionary.diff(t, rules))]
    assert got == [("unchanged", "x", None, None), ("substituted", None, "abc", "1"), ("substituted", None, "bc", "2"), ("unchanged", "y", None, None)]
    assert len(one(spark, "xabcy", lambda t: dictionary.diff(t, rules, dedupe=True))) == 3


def test_highlights_and_counts(spark):
    got = [tuple(x) for x in one(spark, "Claude aud AUD-x", lambda t: dictionary.highlights(t, ["aud", "-x"]))]
    assert got == [("aud", 7, 10), ("aud", 11, 14), ("-x", 14, 16)]
    assert one(spark, "éaud caudé aud", lambda t: dictionary.highlights(t, ["aud"]))[0].start == 1
    assert [(x.real, x.n) for x in one(spark, "ab AB", lambda t: dictionary.counts(t, [Mapping("ab", "", case_sensitive=True), Mapping("b", "")]))] == [("ab", 1), ("b", 2)]


def test_sessions(spark):
    events = spark.createDataFrame([("s", 1, "Bob", "Max"), ("s", 2, "Rob", "MAX"), ("s", 3, "k", "[R]"), ("t", 1, "Ann", "Eve")], "session string, seq int, original string, replaced string")
    dims = spark.createDataFrame([("Robert", "Max"), ("Zoe", "Ida")], "real string, substitute string")
    pairs = dictionary.session_pairs(events, dims)
    assert {tuple(r) for r in pairs.collect()} == {("s", "Max", "Robert"), ("s", "[r]", "k"), ("t", "eve", "Ann")}
    msgs = spark.createDataFrame([("s", "max said [R] to Ida"), ("t", "Eve max"), ("u", "Max")], "session string, text string")
    assert {r.session: r.revealed for r in dictionary.reveal_by_session(msgs, pairs).collect()} == {"s": "Robert said k to Ida", "t": "Ann max", "u": "Max"}


def smartly(spark, text, identity, variant="live"):
    return smart.substitute(spark.createDataFrame([(text,)], "text string"), identity, variant=variant).first().result


WHO = smart.Identity(
    emails=(("john@work.com", "alex@demo.org"),),
    names=(("John", "Alex", "first"), ("Smith", "Demo", "last")),
    usernames=(("jsmith", "ademo"), ("js", "ad")),
    hostnames=(("mybox", "host1"),),
    phones=(("+1 (555) 123-4567", "555-000-0000"), ("12345", "x")),
    catch_all_email="any@x.org",
    email_domains=("corp.com",),
)


@pytest.mark.parametrize("text,want", [
    ("JOHN@work.com and me@gmail.com, you@corp.com, he@else.com", "alex@demo.org and any@x.org, any@x.org, he@else.com"),
    ("call 555.123.4567 or (555) 123-4567 or +1-555-123-4567 or 5551234567", "call 555-000-0000 or 555-000-0000 or 555-000-0000 or 555-000-0000"),
    ("john  smith, SMITH,John; john's JOHN'S Johnny", "Alex Demo, Demo, Alex; Alex's Alex Johnny"),
    ("jsmith@mybox jsmith@far ~jsmith xjsmith jsmith. JSMITH", "ademo@host1 ademo@far ~ademo xjsmith ademo. JSMITH"),
    ("/home/js/a /Users/js C:\\Users\\JS\\x js", "/home/ad/a /Users/ad C:\\Users\\ad\\x js"),
    ("ssh MyBox now", "ssh host1 now"),
])
def test_live(spark, text, want):
    assert smartly(spark, text, WHO).text == want


def test_events_and_variants(spark):
    r = smartly(spark, "a@gmail.com b@gmail.com John", WHO)
    assert [(e.original, e.category, e.pattern) for e in r.events] == [("b@gmail.com", "email", "smart"), ("a@gmail.com", "email", "smart"), ("John", "name", "smart")]
    live = smartly(spark, "/home/jsmith/x", WHO).events
    lib = smartly(spark, "/home/jsmith/x", WHO, "lib").events
    assert [e.category for e in live] == ["path"] and [(e.category, e.pattern) for e in lib] == [("username", "smart-username")]
    off = smart.Identity(names=WHO.names, enabled={"names": False})
    assert smartly(spark, "John", off).text == "John"


def test_profiles():
    p = smart.merge_profiles([{"active": True, "emails": [["a", "b"]], "catch_all_email": ""}, {"active": False, "catch_all_email": "no"}, {"active": True, "emails": [["c", "d"]], "catch_all_email": "yes"}])
    assert p.emails == (("a", "b"), ("c", "d")) and p.catch_all_email == "yes"
    assert smart.missing_fields(p) == ["first name", "last name", "username"]


def test_rules_of_a_table_against_one_rule_after_the_other():
    rng = random.Random(2)
    for _ in range(300):
        word = lambda n: "".join(rng.choice("abAB\u0130\u00df\u017f") for _ in range(rng.randrange(1, n)))
        rules = sorted((pieces.Rule(word(5), word(5), "c", rng.random() < 0.3) for _ in range(8)), key=lambda r: -len(r.real))
        text, want, events = word(40), None, []
        want = text
        for r in rules:
            same = (lambda x, y: x == y) if r.case_sensitive else (lambda x, y: pieces.fold(x) == pieces.fold(y))
            at, out = 0, ""
            while at < len(want):
                piece = want[at : at + len(r.real)]
                if same(piece, r.real):
                    events.append((piece, r.to, "c"))
                    out, at = out + r.to, at + len(piece)
                else:
                    out, at = out + want[at], at + 1
            want = out
        assert pieces.Automaton(rules).substitute(text) == (want, events)


def test_many_rules_of_a_table(spark):
    rules = spark.range(100_000).selectExpr("concat('Key', id, 'x') as real", "concat('V', id) as substitute", "'k' as category", "false as case_sensitive", "true as enabled")
    docs = spark.createDataFrame([(1, "key77X and KEY99999x, key100000x"), (2, None), (3, "Key5x" * 2000)], "id long, text string")
    for block in (dictionary.BLOCK_BYTES, 1 << 20):
        got = {r.id: r.result for r in dictionary.substitute_by_table(docs, rules, block_bytes=block).collect()}
        assert got[1].text == "V77 and V99999, key100000x" and {e.original for e in got[1].events} == {"key77X", "KEY99999x"}
        assert got[2].text is None and got[3].text == "V5" * 2000 and len(got[3].events) == 2000
        assert sorted(map(tuple, dictionary.scan_by_table(docs, rules, "id", block_bytes=block).collect())) == [(1, "Key77x", "V77", "k"), (1, "Key99999x", "V99999", "k"), (3, "Key5x", "V5", "k")]


def test_a_scan_by_a_table_is_sent_and_returned_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "BATCH_ROWS", 3)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64m")
    docs = spark.createDataFrame([(k, "aa bb cc Dd" if k % 3 else None) for k in range(20)], "id int, text string")
    rules = spark.createDataFrame([("aa", "x", "c", False, True), ("AA", "y", "c", False, True), ("dd", "z", "c", True, True), ("Dd", "w", "c", True, True), ("c", None, None, None, True)], "real string, substitute string, category string, case_sensitive boolean, enabled boolean")
    found = dictionary.scan_by_table(docs, rules, "id")
    assert int(spark.conf.get(key)) <= dictionary.BATCH_BYTES
    want = [(k, *r) for k in range(20) if k % 3 for r in (("AA", "y", "c"), ("Dd", "w", "c"), ("aa", "x", "c"), ("c", "", "general"))]
    assert sorted(map(tuple, found.collect())) == want


def test_small_rules_count_in_blocks(spark):
    rules = [dictionary.Rule(f"k{k}", "x", "c", False) for k in range(50_000)]
    blocks = list(dictionary._in_blocks(rules, 1 << 20))
    assert len(blocks) == 2 and [r for b in blocks for r in b] == rules
    assert dictionary._unpacked(dictionary._packed(blocks[0])) == blocks[0]


def test_texts_for_a_tables_rules_are_sent_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64m")
    docs = spark.createDataFrame([(1, "ab ab"), (2, None), (3, "")], "id int, text string")
    rules = spark.createDataFrame([("ab", "x", "c", False, True)], "real string, substitute string, category string, case_sensitive boolean, enabled boolean")
    got = {r.id: (r.result.text, [tuple(e) for e in r.result.events]) for r in dictionary.substitute_by_table(docs, rules).collect()}
    assert int(spark.conf.get(key)) <= dictionary.BATCH_BYTES
    assert got == {1: ("x x", [("ab", "x", "c", None)] * 2), 2: (None, []), 3: ("", [])}


def test_a_blocks_rules_stay_columns_in_a_worker(spark):
    n = 50_000
    sent = SimpleNamespace(value=dictionary._packed([dictionary.Rule(f"NAME#{k:09d}", f"Acct-{k};", "name", k % 2 == 1) for k in range(n)]))
    tracemalloc.start()
    try:
        worker = dictionary._applier(sent).func(iter([pa.array(["name#000000008, name#000000007, NAME#000000007", None])]))
        got = next(worker).to_pylist()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert got[0]["text"] == "Acct-8;, name#000000007, Acct-7;" and [e["original"] for e in got[0]["events"]] == ["NAME#000000007", "name#000000008"]
    assert got[1]["text"] is None
    assert held < 100 * n, held / n


def test_substituted_texts_are_returned_in_bounded_batches(spark, monkeypatch):
    sent = SimpleNamespace(value=dictionary._packed([dictionary.Rule("ab", "xyz", "c", False)]))
    texts = ["ab" * (k % 7) if k % 5 else None for k in range(40)]
    whole = [{"text": None if t is None else "xyz" * (len(t) // 2), "events": [{"original": "ab", "replaced": "xyz", "category": "c", "pattern": None}] * (len(t or "") // 2)} for t in texts]
    for name, most in (("BATCH_ROWS", 9), ("BATCH_BYTES", 20)):
        with monkeypatch.context() as m:
            m.setattr(dictionary, name, most)
            got = list(dictionary._applier(sent).func(iter([pa.array(texts[:30]), pa.array([], pa.string()), pa.array(texts[30:])])))
        assert [r for part in got for r in part.to_pylist()] == whole
        assert max(sum(len(r["events"]) for r in part.to_pylist()[:-1]) for part in got) < 9
    monkeypatch.setattr(dictionary, "BATCH_ROWS", 9)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rules = spark.createDataFrame([("ab", "xyz", "c", False, True)], "real string, substitute string, category string, case_sensitive boolean, enabled boolean")
    rows = dictionary.substitute_by_table(docs, rules).collect()
    assert {r.id: (r.result.text, len(r.result.events)) for r in rows} == {k: (w["text"], len(w["events"])) for k, w in enumerate(whole)}


def test_names_are_looked_at_from_their_first_character(spark):
    texts = ["Ann ann's ANN'S Anna, Joann; AnnAnn Ann", "éann anné _ann ann_ 1ann -ann-", "ſam xſam sam's ſam's Kim kim Kım _Kim", "\U0001f600ann\U0001f600 ann", "a.b xa.b a.b's a.bc .com x.com", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for own in ("Ann", "Sam", "Kim", "Kım", "a.b", ".com", "é", "ann\U0001f600", "1a", "_"):
        for flags in ("", regex.IGNORE_CASE):
            new, old = (f"{flags}{s}(?:'s)?{regex.B}" for s in (regex.word_start(own), regex.B + regex.quote(own)))
            got = rows.select(regex.hits(F.col("t"), new).alias("new"), regex.hits(F.col("t"), old).alias("old"), regex.gaps(F.col("t"), new).alias("g"), regex.gaps(F.col("t"), old).alias("h")).collect()
            assert all(r.new == r.old and r.g == r.h for r in got), own
    assert regex.word_start("Ann").startswith("Ann") and regex.word_start(".com").startswith(regex.B)
    assert smartly(spark, "xAnn ann's ANN", smart.Identity(names=(("Ann", "Eve", "first"),))).text == "xAnn Eve's Eve"
