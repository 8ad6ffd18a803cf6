"""Documents with everything that may go wrong, and their like without rows."""

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, doc long, body string, h long, component long, fp long, id string, key int, "
    "tokens int, number int, block int, rank string, tie string, score double, component_id string, fingerprint string, dropped_lines string, "
    "spans string, bin_id string, contamination string, toxicity string, quality string"
)
CLASH = [None] * 21


def document(doc_id, text):
    return (doc_id, text, None, None, None, *CLASH)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, white space, one word, repeated rows, ties, a null id, a very long text, signs beyond ASCII."""
    long_ = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        document(1, None), document(2, ""), document(3, "  \n\n\t "), document(4, "one"), document(5, "same text of two rows"), document(5, "same text of two rows"),
        document(6, "same text of two rows"), document(None, "no id at all, but words"), document(None, None), document(7, long_),
        document(8, "Ünïcode 漢字かな 🙂 émoji\nsecond line not a line"), document(-9, "x\0y \x1f z"), document(1 << 60, "far id\n\nwith lines\nwith lines"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
