import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from velum.llm import piece_bpe, viterbi

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return f.read()


def odd_texts(seed, n, most=40):
    rng = random.Random(seed)
    parts = ["the", "Thorreou", "running", "unbelievable", "'s", "1234", "É", "größer", "ñandú", "...", "!!,", "  ", "     ", "\n", "\t", "▁", "▁▁▁x", "日本語", "🙂", "ﬁ", "</s>", "<0x41>", "кот", "עברית", "ไทย", "aaaaaa", "antidisestablishment", "_", "\x01", "​", "é", "ḁ̀", "𝒳"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(most))) for _ in range(n)]


def letters(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeinorstuhl ▁.é1") for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_ids_equal_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    e = piece_bpe.MergeEncoder(model)
    for t in [*odd_texts(1, 800), *letters(2, 3000), "", " ", "   ", "x" * 3000, "ab" * 5000, " " * 700, "a " * 50_000, "Zeile\n" * 2000]:
        assert e.encode(t) == [*library.encode(t), 2], t[:80]


def test_backtracking_alone_equals_the_merges(model):
    e = piece_bpe.MergeEncoder(model)
    rng = random.Random(3)
    for _ in range(4000):
        t = "▁" * rng.randrange(2) + "".join(rng.choice("abcdeghilnorstu") for _ in range(rng.randrange(1, 40)))
        assert e.backtrack(t) == e.merge(t)


def test_separate_columns_agree(spark, model):
    df = spark.createDataFrame([(t,) for t in [*odd_texts(9, 30), None, ""]], "text string")
    apart = piece_bpe.with_decoded(piece_bpe.with_ids(df, model), model).select("text", "ids", "decoded")
    both = piece_bpe.with_round_trip(df, model).select("text", "ids", "decoded")
    assert sorted(map(str, apart.collect())) == sorted(map(str, both.collect()))


def test_round_trip_of_odd_rows(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(odd_texts(4, 120))) + [(900, None), (901, ""), (902, "again"), (902, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as decoded").repartition(3)
    got = sorted((tuple(r) for r in piece_bpe.round_trip(df, model).collect()), key=str)
    want = []
    for i, t in rows:
        ids = [*library.encode(t or ""), 2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert piece_bpe.round_trip(df.where("false"), model).count() == 0


def test_counts_equal_the_unigram_library(model):
    model = viterbi.as_unigram(model)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    c = viterbi.Counter(model)
    # sums of up to 2**24 are exact in the library's 32-bit numbers
    checked = 0
    for t in [*odd_texts(5, 1500, 9), *letters(6, 3000), ""]:
        count, score = c.count(t)
        if score > -(2**24):
            checked += 1
            assert count == len(library.encode(t)), t
    assert checked > 2000


def plain(pieces, part):
    best = [(0.0, 0, 0)] + [None] * len(part)
    low = min(pieces.score.values()) - 10
    for start in range(len(part)):
        if best[start] is None:
            continue
        nodes = [(part[start:end], pieces.score[part[start:end]], 1) for end in range(start + 1, min(len(part), start + pieces.longest) + 1) if part[start:end] in pieces.score]
        if part[start] not in pieces.score:
            nodes.append((part[start], low, len(part[start].encode())))
        for x, s, n in nodes:
            to = start + len(x)
            if best[to] is None or best[start][0] + s > best[to][0]:
                best[to] = (best[start][0] + s, best[start][1] + n, 0)
    return best[-1][1], best[-1][0]


def test_counts_equal_plain_dynamic_programming(spark, model):
    model = viterbi.as_unigram(model)
    c = viterbi.Counter(model)
    ts = [*odd_texts(7, 150), *letters(8, 150), "▁" * 40, "long " * 4000]
    rows = list(enumerate(ts)) + [(900, None), (901, ""), (901, ""), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted((tuple(r) for r in viterbi.token_counts(df, model).collect()), key=str)
    want = [(i, *(plain(c.pieces, "▁" + t.replace(" ", "▁")) if t else (0, 0.0))) for i, t in rows]
    assert got == sorted(want, key=str)
    assert viterbi.token_counts(df.where("false"), model).count() == 0
