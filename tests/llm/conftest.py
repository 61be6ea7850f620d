import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows and ids, ties, control characters, a long text."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (4, "a b c"), (None, "x y z"), (5, "naïve café ﬁ 日本 😀 <|endoftext|> <s> ▁ it's 12½"), (6, "\x00\x1c\x85 　 end"), (7, "word " * 30000), (-8, "a b c")]


@pytest.fixture(scope="session")
def prose():
    """Deterministic words."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))

    return make
