import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodespark.llm import bpe, encode
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.default_path()), reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text("ab the\n\t'séñ日0", max_size=300)))
def test_ids_equal_merging(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.encoder(bpe.default_path()).encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_000, "日" * 5_000, "ab" * 9_000, "<|endoftext|>", "\r\n\r\n x", "=" * 777])
def test_long_and_odd_texts(reference, text):
    assert bpe.encoder(bpe.default_path()).encode(text) == reference.encode_ordinary(text)


def test_another_vocabulary():
    path = bpe.default_path("byte_bpe_multi_50k.tiktoken")
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "Ölçüm raporu, métricas de la revisión 日本語のテスト " * 20
    assert bpe.encoder(path).encode(text) == ref.encode_ordinary(text)


def test_corpus(spark, reference):
    df = spark.createDataFrame([(1, "the report", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (None, "a", "x"), (1, "the report", "x")], "doc_id long, text string, ids string")
    got = rows(encode.encode_corpus(df))
    assert got == sorted([(i, reference.encode_ordinary(t or "")) for i, t, _ in df.collect()], key=repr)
    assert encode.encode_corpus(df.limit(0)).count() == 0
