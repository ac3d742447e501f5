import pytest

ODD = [
    (1, "The cat sat on the mat and the dog ran to a house by the sea with all of its friends in tow while the rain fell on the old roof."),
    (2, "The cat sat on the mat and the dog ran to a house by the sea with all of its friends in tow while the rain fell on the old roof."),
    (2, "The cat sat on the mat and the dog ran to a house by the sea with all of its friends in tow while the rain fell on the old roof."),
    (3, ""),
    (4, None),
    (5, " \n\t "),
    (6, "one"),
    (7, "###"),
    (8, "word " * 30_000),
    (9, "a" * 50_000),
    (10, "1" * 20_000),
    (11, "naïve café 北京 \U0001f600 é"),
    (None, "a row without an id but with the words of no other row in it at all so that it stands alone"),
]
EXTRA = "key long, bucket int, n int, sigs string, blob string, kind string, score double, rank int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [(d, t, None, None, None, 7, 7, 7, "x", "x", "x", 0.5, 1) for d, t in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
