import pytest


#: Rows that every operator must take: nulls, empty and blank texts, repeated rows, two texts under one id, a long text.
ODD = [
    (1, "one two three four five six seven eight nine ten eleven"), (1, "one two three four five six seven eight nine ten eleven"),
    (1, "another text under the same id, long enough to be a text of its own kind"), (2, None), (3, ""), (4, " \t\n "), (None, "no id at all here"),
    (None, None), (5, "word " * 40_000), (6, "x" * 30_000), (7, "ÀÉ ß 漢字 \x00 \x1f   é"),
    (8, "one two three four five six seven eight nine ten eleven"),
]


@pytest.fixture
def odd(spark):
    """ODD with further columns whose names the operators use themselves."""
    names = "piece long, start string, length string, range string, token string, sid string, bucket string, payload string, `group` string"
    rows = [(*r, 9, *["clash"] * 8) for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, {names}").repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
