"""Tables with the cases every corpus operator has to stand."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, fp long, component_id long, _id long, digest string, size long, copies int, lines_removed string, host string"


def edge_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{k % 977} idiot" for k in range(60_000))
    texts = [(1, "The cat sat on the mat.\nShared line of text here.", "en", "a"), (2, "The cat sat on the mat.\nShared line of text here.", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, "", None, "b"), (6, long, "en", "c"), (7, " \t\n ", "fr", "c"), (8, "Le chat était là.\nShared line of text here.", "fr", "c"), (9, "Un été à Zürich — 123 <|endoftext|> ’s", "fr", None), (9, "Un été à Zürich — 123 <|endoftext|> ’s", "fr", None), (None, "No id at all.\nShared line of text here.", "en", "a"), (10, "\x00\x0b odd \u2028 signs \ud83d\ude00 e\u0301 Σ ΑΣ".encode("utf-16", "surrogatepass").decode("utf-16"), "en", "b")]
    return [(i, t, g, s, None if t is None else len(t), "x", 0.5, 7, 7, 7, "x", 7, 7, "x", "x") for i, t, g, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
