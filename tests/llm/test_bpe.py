import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")

from siftmill.llm.bpe import PrefixEncoder, TextEncoder, count_tokens, encode_corpus, file_bytes, tokenizer_file, vocabulary  # noqa: E402

PATH, PATTERN = tokenizer_file()
VOCAB = vocabulary(file_bytes(PATH))
ORACLE = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=VOCAB.ranks, special_tokens={})
ENCODER = TextEncoder(file_bytes(PATH), PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODER.encode(text) == ORACLE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=20))
def test_appends(a, b):
    table = PrefixEncoder(VOCAB, a)
    table.append(b)
    assert table.ids() == (ORACLE._encode_single_piece(a + b) if a + b else [])


def test_edits():
    rnd = random.Random(2)
    text = bytearray(rnd.choice(b"the cat in hats and 0123456789 __") for _ in range(6000))
    table = PrefixEncoder(VOCAB, bytes(text))
    for _ in range(20):
        a = rnd.randrange(5900)
        b = a + rnd.randrange(60)
        new = bytes(rnd.choice(b"thing ") for _ in range(rnd.randrange(30)))
        text[a:b] = new
        redone = table.replace(a, b, new)
        assert redone <= len(text) and bytes(table.data) == bytes(text)
        assert table.ids() == ORACLE._encode_single_piece(bytes(text))
    assert table.replace(3000, 3001, b"Q") < 1000  # far behind the edit nothing is worked out anew


def test_other_vocabulary():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    v = vocabulary(file_bytes(str(path)))
    oracle = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    encoder = TextEncoder(file_bytes(str(path)), PATTERN)
    for text in ("Grüße aus Łódź", "данные не найдены", "報告書を削除しないでください", "  \n\n\t x", "a" * 5000):
        assert encoder.encode(text) == oracle.encode_ordinary(text)


def test_corpus(spark):
    texts = [None, "", " ", "<|endoftext|> is text", "é" * 20_000, "a\u2028b\u3000", "same", "same"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids long")
    rows = {r["doc_id"]: r["ids"] for r in encode_corpus(df, "text", PATH, PATTERN).collect()}
    assert rows == {i: ORACLE.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, "text", PATH, PATTERN).collect()}
    assert counts == {i: len(x) for i, x in rows.items()}
    assert encode_corpus(df.limit(0), "text", PATH, PATTERN).count() == 0
    assert b"".join(VOCAB.tokens[i] for i in rows[4]).decode() == texts[4]


def test_executors_do_not_need_the_file(spark, tmp_path):
    own = tmp_path / "own.tiktoken"
    own.write_bytes(file_bytes(PATH))
    out = encode_corpus(spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string"), "text", str(own), PATTERN)
    own.unlink()
    assert {r["doc_id"]: r["ids"] for r in out.collect()} == {1: ORACLE.encode_ordinary("some words"), 2: []}
