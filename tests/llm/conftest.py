import pytest


@pytest.fixture(scope="session")
def sf():
    import os
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test data not present")
    return folder


#: Null and empty texts, ties, repeated rows, null ids, white space only, odd
#: code points, a long text.
ODD_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again"),
    (2, "the QUICK brown fox jumps over the lazy dog again and again"),
    (2, "the QUICK brown fox jumps over the lazy dog again and again"),
    (3, None), (4, ""), (5, " \t\n\x0b "), (6, "é É ß x \U0001F600 Ünïcode wörds"),
    (7, "one two three"), (8, "ONE two three"), (None, "one two three"), (None, None),
    (9, "\n\n  The quick brown fox jumps over the lazy dog again and again \nshort\n"),
    (10, "word " * 30_000), (11, "<|endoftext|> it's 2024, <|startoftext|>don't!"),
    (12, "The quick brown fox jumps over the lazy dog again and again and more"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with more columns, whose names operators use inside."""
    schema = ("doc_id long, text string, doc string, n string, size string, link string, shard int, key string, "
              "fallen string, lang string, source string, lang_pred string, pivot long, r long, place long, n_hit long")
    rows = [(i, t, "x", "y", "z", None, 3, "k", "f", "en", "s", "p", 1, 2, 3, 4) for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


def lower_ascii(text):
    return text.translate({c: c + 32 for c in range(65, 91)})
