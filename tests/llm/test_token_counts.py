import pytest

P = pytest.importorskip("public_tokenizers")

from ledgerlens.llm.token_counts import _by_pre_token, counter, drops_white_space, token_counts  # noqa: E402

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def test_only_the_word_tokenizer_is_cut_up():
    assert [drops_white_space(P.path(n)) for n in NAMES] == [True, False, False]


@pytest.mark.parametrize("name", NAMES)
def test_equals_the_library(spark, sf, odd, name):
    encode = counter(P.path(name))
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        texts = sorted(((r["doc_id"] or -1, r["text"] or "") for r in docs.collect()))
        want = sorted((i, len(t.encode()), n, n > 100) for (i, t), n in zip(
            texts, encode([t for _, t in texts]), strict=True))
        got = sorted((r["doc"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(
            docs, P.path(name), 100).collect())
        assert got == want


def test_white_space_and_special_strings():
    """Texts cut at ASCII white space count like whole ones."""
    encode = counter(P.path(NAMES[0]))
    texts = ["a<|endoftext|>b", "<|endoftext|> <|startoftext|>", "x́ ́y", "a\x1cb\x85c d", "I'll 'S 'll've",
             "...!?\t\r\n--", "é\n̈", "ﬁ Ⅷ ½ 12345", "﻿x", "İstanbul ΑΣ ς", "\x00 \x01", "a" * 5000]
    got = _by_pre_token([t.encode() for t in texts], {}, {}, encode)
    assert got == encode(texts)


def test_empty(empty):
    assert token_counts(empty, P.path(NAMES[0])).count() == 0


def test_table_and_cache_do_not_matter(spark, sf, monkeypatch):
    import ledgerlens.llm.token_counts as module
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = P.path(NAMES[0])
    a = sorted(map(tuple, token_counts(docs, path).collect()))
    assert a == sorted(map(tuple, token_counts(docs, path, table=1).collect()))
    assert len(module.frequent_pre_tokens(docs, table=50, summary=60)) == 50
