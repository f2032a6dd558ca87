"""The pipeline against planted rows and plain versions of its stages."""

import random

import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_decontam import brute as contaminated
from velum.llm.queries import vocabulary

WORDS = {"en": ["the", "thing", "with", "other", "morning", "water", "and", "street"], "de": ["der", "schön", "größe", "nicht", "wasser", "straße", "und", "abend"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    sentence = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        lang = rng.choice(["en", "de"])
        text = sentence(lang, rng.randrange(20, 90))
        toxic = i % 5 == 0
        if toxic:
            text += " idiot scum " + rng.choice(["moron", "clown"])
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
        if i % 4:
            labels.append((i, 1, int(toxic)))
    bench = [(k, sentence("en", 15)) for k in range(5)]
    more = [docs[7][1], docs[7][1] + " ", docs[11][1] + "\n" + bench[0][1], bench[1][1], None, "", "12 34 ..", sentence("de", 4000), "idiot scum moron " + sentence("en", 30)]
    docs += [(1000 + k, t, "en", None, None) for k, t in enumerate(more)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, bench


def test_stages_against_plain_versions(spark, folder, tmp_path):
    path, rows, bench = folder
    text = {r[0]: r[1] for r in rows}
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.collect()}
    assert kept["language_id"] == set(text) - {1004, 1005, 1006}
    assert kept["toxicity"] == {i for i in kept["language_id"] if "idiot" not in text[i]}
    assert kept["near_dedup"] == one_of_each([(i, text[i]) for i in sorted(kept["toxicity"])])
    assert {1000, 1001, 1002} & kept["near_dedup"] == set()
    found = contaminated([(i, text[i]) for i in sorted(kept["near_dedup"])], bench, 10)
    assert kept["decontamination"] == {i for i, x in found.items() if not x[-1]} and not {1002, 1003} & kept["decontamination"]
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    assert {r.doc_id: list(r.ids) for r in docs.collect()} == {i: [*library.encode(text[i]), 2] for i in kept["decontamination"]}


def one_of_each(rows):
    """The ids that stay: all pairs by the exact index of their five-word shingles."""
    sets, up = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {rows[k][0] for k in range(len(rows)) if top(k) == k}


def test_run_is_its_stages(spark, folder):
    path, _, _ = folder
    got = entry.queries()["pipeline"](spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() > 200
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_empty_documents(spark, folder, tmp_path):
    path, _, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
