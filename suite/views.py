"""Forum-shaped views over the given tables. The same text runs on Spark and in the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmine.operators.normalize import normalize_comments, normalize_posts

RAW_POSTS = """
SELECT CAST(d.doc_id AS STRING) AS id, d.source AS subreddit,
  split_part(d.text, chr(10), 1) AS title,
  CASE WHEN d.doc_id % 41 = 0 THEN NULL ELSE concat(d.text, '; see ', coalesce(p.url, 'nolink'),
    ' and r/Src_', CAST(d.doc_id % 5 AS STRING), ' r/top', CAST(d.doc_id % 3 AS STRING)) END AS selftext,
  CASE WHEN d.doc_id % 29 = 0 THEN NULL ELSE concat('user', CAST(d.doc_id % 37 AS STRING)) END AS author,
  coalesce(l.toxic, 0) = 1 AS over_18, d.doc_id % 50 AS num_comments,
  CAST(d.doc_id % 100 AS DOUBLE) / 100 AS upvote_ratio, CAST(NULL AS STRING) AS distinguished,
  CAST(1704067200 + d.doc_id * 3600 AS DOUBLE) AS created_utc,
  concat('/r/', d.source, '/', CAST(d.doc_id AS STRING)) AS permalink, (d.doc_id * 7919) % 1000 AS score
FROM {documents} d LEFT JOIN {pages} p ON p.page_id = d.doc_id LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

# Posts whose whole text is a document, so that copies are copies.
RAW_COPIES = """
SELECT CAST(d.doc_id AS STRING) AS id, d.source AS subreddit, CAST(NULL AS STRING) AS title, d.text AS selftext,
  concat('user', CAST(d.n_chars % 37 AS STRING)) AS author, false AS over_18, CAST(0 AS BIGINT) AS num_comments,
  CAST(0 AS DOUBLE) AS upvote_ratio, CAST(NULL AS STRING) AS distinguished,
  CAST(1704067200 + d.doc_id * 3600 AS DOUBLE) AS created_utc, CAST(NULL AS STRING) AS permalink,
  CAST(0 AS BIGINT) AS score
FROM {documents} d
"""

# Posts that are web pages: their markup is full of links.
RAW_PAGES = """
SELECT CAST(p.page_id AS STRING) AS id, 'web' AS subreddit, p.url AS title, p.html AS selftext,
  CAST(NULL AS STRING) AS author, false AS over_18, CAST(0 AS BIGINT) AS num_comments,
  CAST(0 AS DOUBLE) AS upvote_ratio, CAST(NULL AS STRING) AS distinguished,
  CAST(1704067200 AS DOUBLE) AS created_utc, CAST(NULL AS STRING) AS permalink, CAST(0 AS BIGINT) AS score
FROM {pages} p
"""

RAW_COMMENTS = """
SELECT CAST(conv_id AS STRING) AS post_id, concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS id,
  concat(role, CAST(conv_id % 11 AS STRING)) AS author,
  CASE WHEN (conv_id + turn) % 10 = 0 THEN '[deleted]' ELSE text END AS body, turn <= 1 AS parent_is_post
FROM {conversations}
"""

DESCRIPTION = """
SELECT DISTINCT source AS subreddit FROM {documents} WHERE source <> 'src3' UNION ALL SELECT 'src_empty' AS subreddit
"""

BUNDLED_TERMS = "SELECT CAST(p_partkey AS INT) AS pos, p_name AS term FROM {part}"

# One query per benchmark item: all runs of three words of its text, or the whole text if it is shorter.
PHRASES = """
SELECT CAST(item_id AS VARCHAR) AS query, i AS place, array_to_string(w[i:i + 2], ' ') AS term
FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))
"""

KEYWORDS = ["thing", "ering", "ertion", "and the", "Of The", "zzzz"]
SCOPES = ["all", "src1", "src3", "src_empty"]
AUTHORS = ["user1", "user2", "nobody"]
STOPWORDS = (
    "a an and are as at by de des die der das don en et for in is it la le les nd of on or that the this to un une was "
    "with don't"
).split()
LEMMAS = {"things": "thing", "ertions": "ertion", "erings": "ering", "ouen": "oue", "tions": "tion"}
AS_OF = "2025-01-20 00:00:00"


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer splits than there are cores, dealt out to all cores.

    Large tables come in many splits and pass through unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A view of the given tables. Texts arrive in one split and are dealt out to all cores."""
    names = [n for n in ("documents", "pages", "labels", "conversations", "part") if "{" + n + "}" in text]
    tables = {n: table(spark, folder, n) for n in names}
    for name, column in (("documents", ".text"), ("pages", ".html")):
        if name in tables and column in text:
            tables[name] = spread(tables[name])
    return spark.sql(text, **tables)


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    """What PHRASES says in SQL: rows ``(query, place, term)``."""
    words = table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("query"), F.split("text", " ").alias("w"))
    places = F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)))
    return words.select("query", "w", F.explode(places).alias("place")).select("query", "place", F.array_join(F.slice("w", F.col("place"), F.lit(3)), " ").alias("term"))


def posts(spark: SparkSession, folder: str, raw: str = RAW_POSTS, link_mode: str = "strict") -> DataFrame:
    return normalize_posts(view(spark, folder, raw), link_mode)


def comments(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_comments(view(spark, folder, RAW_COMMENTS))
