import random

import pytest

#: Names that operators use inside; tables may have them too.
CLASHING = "size row cell rank node label n copies key block token held words u v bucket _row score start end target slot shard k1 host line measures pattern x m rep hood comp sig id".split()


def prose(rng, n, vocabulary=900, stem="w"):
    return " ".join(f"{stem}{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows: (doc_id, text, lang, source)."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, "a"), (4, "one", "en", None), (5, prose(rng, 80), None, None), (6, long, "en", "a"),
        (7, long, "fr", "b"), (8, prose(rng, 60), "fr", "b"), (8, prose(rng, 60), "fr", "b"), (9, "same words here twice over " * 20, "en", "b"),
        (9, "same words here twice over " * 20, "en", "b"), (None, prose(rng, 70), "en", "a"), (None, None, None, None), (10, "é" * 5000, "fr", "c"), (11, "0" * 20_000 + "@", "en", "c"),
        (12, "<|endoftext|> ok \x1c\x85 　 Ⅷ mail a.b@c.de +49 30 1234567 1.2.3.4", "en", "c"), (-3, "line\nline\nline\n" * 30, "en", "c"),
    ]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    """The edge rows as a table with extra columns of clashing names, some null."""
    df = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string")
    for i, name in enumerate(CLASHING):
        df = df.selectExpr("*", f"{'cast(null as string)' if i % 3 == 0 else i} as `{name}`")
    return df


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")
