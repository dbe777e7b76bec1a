import random

import pytest

#: Rows with the cases every operator must bear; the columns after n_chars clash with internal or result names.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, shard string, kept string, spans string, "
    "score double, node long, class_id string, k1 long, row string, n_words string, term string, entity string, host string, `a.b` string"
)
EXTRA = (0, 7, "s", "k", "sp", 0.5, 1, "c", 2, "r", "w", "t", "e", "h", "dot")


def doc(i, text, lang="en", source="s1"):
    return (i, text, lang, source, None if text is None else len(text), *EXTRA)


def prose(n, seed=0, vocabulary=400):
    rng = random.Random(seed)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    long = prose(30_000, 1)
    rows = [
        doc(1, None), doc(2, ""), doc(3, " \t\n "), doc(4, "one"), doc(5, prose(80, 2)), doc(5, prose(80, 2)), doc(6, prose(80, 2)), doc(7, prose(80, 3), None, None),
        doc(None, prose(80, 4)), doc(None, None), doc(8, long), doc(9, "Käse größer ñandú " * 30, "de", "ä"), doc(10, "a" * 5000), doc(11, "\U0001f600 tail " * 60),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
