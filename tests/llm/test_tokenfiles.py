import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from velum.llm import tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def made():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", "Thor's", "DON'T", "it'll", "''s", "'", "1234", "²³", "É", "ß", "ñandú", "...", "!!,", "<|endoftext|>", "<|start", "\x1f", "\x00", "\xa0", "\x85", "İ", "ΣΑΣ", "é", " ́", "日本語", "🙂", "ﬁ", "​", "_", "a_b", "x" * 70, "'S", "\n\n", "\t", "µ", "ª", "½x"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_ids_equal_the_library(made):
    tok = Tokenizer.from_file(PATH)
    e = tokenfiles.Encoder(made, 1)
    assert e.by_word and e.dtype.itemsize == 2
    ts = [*odd_texts(1, 1500), "", "a " * 400_000]
    for t, got in zip(ts, e.encode(ts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t[:80]


def test_what_was_met_before_is_not_cut_again(made, monkeypatch):
    cut, words = [], tokenfiles._WORDS

    class Counted:
        def findall(self, text):
            cut.append(text)
            return words.findall(text)

    monkeypatch.setattr(tokenfiles, "_WORDS", Counted())
    e = tokenfiles.Encoder(made, 1)
    ts = ["The cat, the cat's 12 x! " * 500] * 4
    want = [*Tokenizer.from_file(PATH).encode(ts[0], add_special_tokens=False).ids, 1]
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(ts)] == [want] * 4
    assert sum(map(len, cut)) < 100


def test_ids_stay_when_words_are_put_aside(made, monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHED_BYTES", 4000)
    tok, e = Tokenizer.from_file(PATH), tokenfiles.Encoder(made, 1)
    rng = random.Random(4)
    parts = ["the", "cat's,", "Ñandú.", "ß-ö", "²³", "(µ)", *[f"w{chr(97 + k % 26)}{chr(224 + k % 23)}{k};" for k in range(300)]]
    for _ in range(20):
        ts = [" ".join(rng.choices(parts, k=60)) for _ in range(10)]
        for t, got in zip(ts, e.encode(ts), strict=True):
            assert np.frombuffer(got, "<u2").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], t
        assert e.known.held < 40_000


def test_other_tokenizers_are_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        e = tokenfiles.Encoder(f.read(), 70_000)
    ts = odd_texts(2, 50)
    assert not e.by_word and e.dtype.itemsize == 4
    assert [np.frombuffer(x, "<u4").tolist()[:-1] for x in e.encode(ts)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ts]


def test_files_hold_all_documents_in_order(spark, made, tmp_path):
    tok = Tokenizer.from_file(PATH)
    rows = list(enumerate(odd_texts(3, 300), start=-20)) + [(900, None), (901, ""), (902, "again"), (902, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as start").repartition(4)
    got = [tuple(r) for r in tokenfiles.token_files(df, made, 1).orderBy("start").collect()]
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    folder = f"file://{tmp_path}/out"
    manifest = tokenfiles.write_token_files(df, folder, made, 1).collect()
    assert sum(m.n_docs for m in manifest) == len(rows)
    nulls, own, offsets, ids = tokenfiles.open_part(folder, manifest[0].file)
    every = ids(0, int(offsets[-1]))
    assert isinstance(every, np.memmap) and nulls == 1 and offsets[-1] == len(every) and len(own) == manifest[0].n_docs


def test_least_id_and_files_off_local_folders(spark, made, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "PART_BYTES", 40)
    rows = [(-(1 << 63), "least"), (None, "none"), (None, "x y"), *((k, "word " * k) for k in range(20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tokenfiles.write_token_files(df, f"file://{tmp_path}/out", made, 1)
    assert manifest.count() > 3
    got = tokenfiles.read_token_files(manifest, f"file://{tmp_path}/out").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), *range(20)]
    first = manifest.orderBy("part").first().file
    mapped = tokenfiles.open_part(f"file://{tmp_path}/out", first)
    import pyarrow.fs as pafs

    there = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    monkeypatch.setattr(tokenfiles, "_filesystem", lambda uri: (there, "out"))
    read = tokenfiles.open_part("any://folder", first)
    end = int(mapped[2][-1])
    assert not isinstance(read[3](0, end), np.memmap) and read[3](1, end).tolist() == mapped[3](1, end).tolist()


def test_empty(spark, made):
    assert tokenfiles.token_files(spark.createDataFrame([], "doc_id long, text string"), made, 1).count() == 0


def test_files_are_rolled_and_hot_ids_parted(spark, tmp_path, monkeypatch, made):
    monkeypatch.setattr(tokenfiles, "PART_BYTES", 400)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"some words {k} " * (k % 5)) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        one = tokenfiles.write_token_files(df, f"{tmp_path}/a", made, 1)
        assert one.where("n_docs > 40").count() == 0 and one.count() > 4
        got = sorted(map(tuple, tokenfiles.read_token_files(one, f"{tmp_path}/a").select("start", "n_tokens").collect()))
        assert [s for s, _ in got] == [0, *itertools.accumulate(n for _, n in got)][:-1] and len(got) == 150
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
