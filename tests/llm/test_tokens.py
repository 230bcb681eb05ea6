import random

import numpy as np
import pytest

from eventloom.llm import tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def enc():
    return tokens.encoding()


def texts():
    rng = random.Random(7)
    parts = ["word", " ", "  ", "\n\n", "\t", "'s", "'re", "''", "don't", "123", " 45", "中文", "ñandú", "🚀⭐", "<|endoftext|>", "---", "a" * 40, " ", "...", "x'll"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(120)] + ["", " ", "a" * 3000, " " * 3000, "'" * 500, "é" * 999]


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (64, 32), (256, 24)])
def test_chunks_give_the_whole_encoding(enc, chunk, overlap):
    for text in texts():
        assert tokens.encode_text(text, enc, chunk, overlap).tolist() == enc.encode_ordinary(text)


def test_corpus(spark, enc):
    rows = [(k, t, "clash") for k, t in enumerate(texts())] + [(900, None, ""), (901, "long text " * 900, ""), (901, "long text " * 900, ""), (902, "x" * 60_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect())
    assert got == sorted((k, enc.encode_ordinary(t or "")) for k, t, _ in rows)
    small = sorted((r.doc_id, r.ids) for r in tokens.encode_corpus(df, chunk=200, overlap=32).collect())
    assert small == got
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_round_trip(enc):
    for text in texts():
        assert tokens.decode_ids(tokens.encode_text(text, enc, 64, 32)).decode() == text


def test_no_common_boundary_is_handled(enc):
    text = "b" * 100 + " tail"
    chunks = [(s, t, tokens.pre_tokens(t) + s) for s, t in tokens.split_chunks(text, 20, 4)]
    pieces = tokens.stitch(chunks, len(text))
    assert np.concatenate([tokens._encode_piece(text[a:b], enc) for _, a, b in pieces]).tolist() == enc.encode_ordinary(text)
