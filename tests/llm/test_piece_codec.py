import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import piece_codec as pc

sentencepiece = pytest.importorskip("sentencepiece")
PATH = pc.default_model()
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pc.load_model(PATH)


def check(texts):
    flat, at = pc.Encoder(MODEL)(texts)
    got = [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    want = [SP.encode(t) for t in texts]
    assert got == want
    assert [b.decode() for b in pc.Decoder(MODEL)(flat.astype("int64"), at)] == [SP.decode(i) for i in want]


def test_odd_texts():
    check(["", " ", "  a", "a  ", " \n\t x", "▁a", "<s> hi </s>", "\x00a", "a b", "﻿x", "\U0001f600", "\r\n", "　", "ﬁ", "\n\n\n  \n", " " * 37 + "x" + " " * 40, "th" * 50, "a" * 300, "ththethethth tht"])


def test_random_syllables():
    r = random.Random(3)
    parts = ["th", "e", "t", "h", "ing", "in", "g", " ", "  ", "an", "n", "\n", "é", "ß", "了", ".", "!!"]
    check(["".join(r.choice(parts) for _ in range(r.randrange(1, 80))) for _ in range(800)])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    if not any(0xD800 <= ord(c) < 0xE000 for c in t):
        check([t])


def test_long_words():
    r = random.Random(5)
    check(["".join(r.choice("abthein") for _ in range(3 * pc.LONG_WORD)), "".join(r.choice(["th", "the", "ing", "hethe", "了", "aaa"]) for _ in range(pc.LONG_WORD)), "ab" * pc.LONG_WORD])
    check(["".join(r.choice("abthein ") for _ in range(3 * pc.LONG_WORD)), "x" * (pc.LONG_WORD + 9), " " * (pc.LONG_WORD + 50) + "b"])


def test_frames(spark):
    docs = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (2, None, None), (None, "", "z"), (3, "z" * 20000, "q")], "doc_id long, text string, ids string")
    rows = pc.decode(pc.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows) == sorted([(1, SP.encode("a b"), "a b")] * 2 + [(2, [], ""), (0, [], ""), (3, SP.encode("z" * 20000), "z" * 20000)])
    assert pc.decode(pc.encode(docs.limit(0), PATH), PATH).count() == 0


def test_long_rounds_on_short_words():
    """The linked rounds give what the library gives on any word."""
    r = random.Random(6)
    parts = ["th", "e", "t", "h", "ing", "in", "g", "an", "n", "é", "ß", "了", ".", "!!", "aa"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(2, 60))) for _ in range(300)]
    old = pc.LONG_WORD
    pc.LONG_WORD = 1
    try:
        check(texts)
    finally:
        pc.LONG_WORD = old


def test_cache_is_bounded_in_bytes():
    e = pc.Encoder(MODEL)
    r = random.Random(7)
    long = ["".join(r.choice("abcdefgh") for _ in range(1000)) for _ in range(200)]
    for t in long:
        flat, _ = e([t + " and a few more"])
        assert flat.tolist() == SP.encode(t + " and a few more")
    assert len(e.known) <= 5 and len(e.flat) == sum(e.length) and e.held < 5000
    assert e(["and a few"])[0].tolist() == SP.encode("and a few")


def test_the_query_against_the_library(spark, tmp_path):
    import hashlib

    digest = lambda b: hashlib.sha256(b).hexdigest()
    rows = [(1, "a b th", "k"), (1, "a b th", "k"), (2, None, None), (None, "", "z"), (3, "z" * 20000, "q"), (4, "x\ny  \U0001f600", "q")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t, _ in rows:
        ids = SP.encode(t or "")
        want.append((i or 0, len(ids), digest(",".join(map(str, ids)).encode()), digest(SP.decode(ids).encode())))
    got = pc.op2_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    clash = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = pc.encode_decode(clash, PATH)
    assert out.columns == ["doc_id", "ids", "decoded"] and sorted(r.decoded for r in out.collect()) == sorted(SP.decode(SP.encode(t or "")) for _, t, _ in rows)
    assert pc.encode_decode(clash.limit(0), PATH).count() == 0
