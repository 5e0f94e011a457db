"""Terms of long lists are looked for at the places of a text, which are rows of compiled code."""

from postmine.operators import terms
from tests.compare import plan


def test_places_are_rows(spark):
    texts = spark.createDataFrame([("k", "some text")], "_text_key string, _text string")
    listed = spark.createDataFrame([(0, "me te"), (1, "some text")], "pos int, term string")
    assert "lambdafunction" not in plan(terms.joined_hits(texts, listed))


def test_terms_at_places_of_any_bytes(spark):
    long = "é" * terms.STEP
    texts = {"a": f"{long}straße 😀😀😀 zum{long}", "b": "x" * (terms.STEP - 2) + "across the step", "c": "", "d": "😀", "e": "́é", "f": None}
    listed = ["", "é", "éstraße", "straße 😀", "😀😀😀 zum", "😀", "zumé", "xxacross", "across the step", "the steps", "́", "é", "é" * 13, "ṕ"]
    df = spark.createDataFrame(list(texts.items()), "_text_key string, _text string")
    table = spark.createDataFrame(list(enumerate(listed)), "pos int, term string")
    found = {(r._text_key, r.term) for r in terms.joined_hits(df, table).collect()}
    assert found == {(k, x) for k, text in texts.items() if text is not None for x in listed if x in text}
