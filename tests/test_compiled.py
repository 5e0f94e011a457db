"""What is done for every word or place of a text is a row of compiled code, and is done once."""

import pytest
from pyspark.sql import functions as F

from postmine.functions import text as t
from postmine.operators import features
from suite import views as v
from tests.compare import plan

FOLDER = "/root/testdata/sf0.001"


def test_ngrams_are_rows(spark):
    posts = v.posts(spark, FOLDER)
    assert "lambdafunction" not in plan(features.frequent_ngrams(posts, v.STOPWORDS, v.LEMMAS))


def test_mentions_and_their_gate_clean_texts_once(spark):
    posts = v.posts(spark, FOLDER)
    assert "documents.parquet" not in plan(features.mentions(posts, v.STOPWORDS, v.LEMMAS))


@pytest.mark.parametrize("text", [
    "", " ", "a", "..a--b__c", "Don't (stop)!", "x@y.z #tag “q”", "a  b\tc   d", "<newline>a<newline><newline>b", "  é\u0085ñ　", "İ Σας ß", "😀 a_b 9 ½",
])
def test_tokens_and_words_as_found_by_pattern(spark, text):
    df = spark.createDataFrame([(text,)], "x string")
    x = F.col("x")
    row = df.select(
        t.raw_tokens(x).alias("tokens"), F.regexp_extract_all(F.lower(x), F.lit(t.TOKEN_PATTERN), F.lit(0)).alias("by_pattern"),
        t.ngram_words(x).alias("words"), F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("words_by_pattern"),
        t.tidy(x).alias("tidy"), t.strip(F.regexp_replace(F.translate(F.replace(x, F.lit("<newline>"), F.lit(" ")), "\t", " "), " +", " ")).alias("tidy_by_pattern"),
    ).first()
    assert row.tokens == row.by_pattern and row.words == row.words_by_pattern and row.tidy == row.tidy_by_pattern
