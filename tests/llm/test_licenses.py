import random
import re
import time

import pytest

from velum.llm import licenses


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for i in range(len(w)) for p, label in licenses.BASE.items() if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_base_against_brute_force(spark):
    rng = random.Random(8)
    parts = ["gnu", "General", "public", "license", "CC", "by", "MIT", "Apache", "é", "mit license", "x"]
    rows = [(i, rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "cc by " * 20000), (503, "cc by cc by"), (503, "cc by cc by"), (None, "mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as s", "'l' as labels")
    got = sorted(((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(df).collect()), key=str)
    assert got == sorted(((i or -1, *brute(t)) for i, t in rows), key=str)
    assert licenses.scan_licenses(df.where("false")).count() == 0


@pytest.mark.parametrize("text,form,score", [
    ("MIT OR GPL-2.0-only", "mit or gpl-2.0-only", 1.0),
    ("(MIT OR GPL-3.0) AND CC-BY-NC-4.0 trailing words", "(mit or gpl-3.0) and cc-by-nc-4.0", 0.1),
    ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", "gpl-2.0 with classpath-exception-2.0 and mit", 0.6),
    ("MIT AND Apache-2.0 OR AGPL-3.0", "mit and apache-2.0 or agpl-3.0", 1.0),
    ("MIT AND (Apache-2.0", "mit", 1.0),
    ("MIT) OR", "mit", 1.0),
])
def test_expressions(text, form, score):
    value, got, _ = licenses.evaluate(licenses.parse(text.lower())[0])
    assert got == form and value == pytest.approx(score)


def test_tags_and_notices():
    s = licenses.Scanner().scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-4.0\nLicensed under CC BY-NC 4.0.")
    assert s["expressions"] == ["(mit or apache-2.0) and cc-by-4.0"]
    assert s["labels"] == "apache-2.0,cc-by,cc-by-4.0,cc-by-nc,cc-by-nc-4.0,mit" and s["base_labels"] == "cc-by" and s["score"] == 0.1
    assert licenses.parse("and or") == ([], 0) and licenses.Scanner().scan("SPDX-License-Identifier:")["expressions"] == []


@pytest.mark.parametrize("text,form", [
    ('license_expression = "MIT OR Apache-2.0"', "mit or apache-2.0"), ('SPDX-License-Identifier: "MIT"', "mit"), ("SPDX-License-Identifier: MIT.", "mit"),
    ("SPDX-License-Identifier: '(MIT)' etc", "mit"), ("SPDX-License-Identifier: GPL-2.0 WITH X. OR MIT", "gpl-2.0 with x"),
])
def test_quotes_and_ends_of_sentences(text, form):
    s = licenses.Scanner().scan(text)
    assert s["expressions"] == [form] and not any(x.endswith(".") for x in s["labels"].split(","))


def test_long_texts_take_no_square_of_their_length():
    began = time.process_time()
    s = licenses.Scanner().scan("mit license cc by " * 300_000)
    assert s["n_base"] == 600_000 and s["last_word"] == 4 * 299_999 + 2
    for long in ("mit or " * 300_000 + "mit", "mit or (" * 100_000 + "mit" + ")" * 100_000, "(" * 300_000 + "mit", "mit or (" * 300_000):
        polish, _ = licenses.parse(long)
        assert not polish or licenses.evaluate(polish)[0] == 1.0
    assert time.process_time() - began < 60


def plain(text):
    """Labels and score without expressions: the words of each phrase, looked for at each place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = {x for phrases in (licenses.BASE, licenses.NOTICES) for p, x in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
    return ",".join(sorted(found)), min((licenses.openness(x) for x in found), default=0.0)


def test_labels_and_score_against_brute_force(spark):
    rng = random.Random(9)
    parts = [*licenses.BASE, *licenses.NOTICES, "gnu", "license", "cc", "by", "version 2", "x", "4.0"]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(8)))) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(df).collect()} == {i: plain(t) for i, t in rows}


@pytest.mark.parametrize("text,labels,expressions", [
    ("SPDX License Identifier: MIT", "mit", ["mit"]), ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nx", "apache-2.0,mit", ["mit or apache-2.0"]), ('"license-expression": "BSD-3-Clause"', "bsd-3-clause", ["bsd-3-clause"]),
    ("license_expression = 'ISC' and more", "isc", ["isc"]), ("spdx license identifier MIT", "", []), ("é SPDX—License—Identifier : MIT", "", []), ("SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC", "mit", ["mit"]),
])
def test_the_place_of_a_tag_leads_to_its_expression(text, labels, expressions):
    got = licenses.Scanner().scan(text)
    assert (got["labels"], got["expressions"]) == (labels, expressions)
