"""Describing a stored collection: counts, mentions, n-grams and domains per community."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmine.operators.features import (
    MIN_COUNT, MIN_POSTS, NGRAM_SIZES, domains_of, feature_counts, mentions_of, ngrams_of,
)
from postmine.operators.groups import MAX_ENTRIES, fold_counts
from postmine.operators.relations import comments_per_subreddit
from postmine.schemas import COUNTS, DESCRIPTION
from postmine.session import scratch_dir
from postmine.sources.stored import read_description, read_posts, write_csv


class Enriched(NamedTuple):
    """One row per community, and its counted features in long form."""

    description: DataFrame
    mentions: DataFrame
    ngrams: DataFrame
    domains: DataFrame


def enrich(
    desc: DataFrame,
    posts: DataFrame,
    stopwords: DataFrame | Sequence[str] = (),
    lemmas: DataFrame | Mapping[str, str] | None = None,
    comments: DataFrame | None = None,
    lim: int = MIN_COUNT,
    sizes: tuple[int, int] = NGRAM_SIZES,
    min_posts: int = MIN_POSTS,
    link_mode: str = "strict",
    out: str | None = None,
) -> Enriched:
    """Everything known about the communities of ``desc``, from one scan of the posts.

    The counts are written to ``out`` first, by default below the shared folder of the cluster,
    and the four results read that table. N-grams below ``lim`` are not kept.
    """
    spark = posts.sparkSession
    out = out or f"{scratch_dir(spark)}/features-{uuid.uuid4().hex}"
    counts = feature_counts(posts, stopwords=stopwords, lemmas=lemmas, sizes=sizes, link_mode=link_mode, least_ngrams=lim)
    counts.write.mode("errorifexists").partitionBy("kind").parquet(out)
    counts = spark.read.schema(counts.schema).parquet(out)
    named = desc.select("subreddit").distinct()
    n_posts = counts.filter(F.col("kind") == "post").select("subreddit", F.col("cnt").alias("n_posts"))
    description = named.join(n_posts, "subreddit", "left")
    if comments is None:
        description = description.withColumn("n_comments", F.lit(0).cast("long"))
    else:
        description = description.join(comments_per_subreddit(posts, comments), "subreddit", "left")
    description = description.fillna(0, ["n_posts", "n_comments"])

    def known(features: DataFrame) -> DataFrame:
        return features.join(named, "subreddit", "left_semi")

    return Enriched(
        description, known(mentions_of(counts)), known(ngrams_of(counts, n_posts, lim, min_posts)), known(domains_of(counts))
    )


def reload_and_enrich(
    spark: SparkSession,
    posts_path: str,
    description_path: str,
    columns: Sequence[str],
    out: str,
    stopwords: DataFrame | Sequence[str] = (),
    lemmas: DataFrame | Mapping[str, str] | None = None,
    comments: DataFrame | None = None,
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """A stored collection read again, its description completed and written to ``out``.

    ``columns`` names what the stored description holds. Columns that it has are kept as they are; only
    absent ones are made, and if none is absent the posts are not read. Further rows of a large community
    are told apart by ``part``, as in ``description_with_maps``.
    """
    desc = read_description(spark, description_path, list(columns), index_column=False)
    if "part" not in desc.columns:
        desc = desc.withColumn("part", F.lit(0).cast("long"))
    absent = [c for c in DESCRIPTION.fieldNames() if c not in desc.columns]
    if absent:
        posts = read_posts(spark, posts_path, index_column=False)
        made = description_with_maps(enrich(desc, posts, stopwords, lemmas, comments), max_entries).alias("made")
        stored = desc.alias("stored")
        same = [F.col(f"made.{c}").eqNullSafe(F.col(f"stored.{c}")) for c in ("subreddit", "part")]
        key = [F.coalesce(f"made.{c}", f"stored.{c}").alias(c) for c in ("subreddit", "part")]
        kept = [c for c in DESCRIPTION.fieldNames() if c not in ("subreddit", "part", *absent)]
        both = made.join(stored, same[0] & same[1], "full")
        desc = both.select(*key, *(f"made.{c}" for c in absent), *(f"stored.{c}" for c in kept))
        # Further parts of what was made hold nothing that was stored, and the other way round.
        nothing = {f.name: F.create_map().cast(f.dataType) if f.dataType == COUNTS else F.lit(0).cast(f.dataType) for f in DESCRIPTION}
        filled = {c: F.when(F.col("part") > 0, F.coalesce(c, nothing[c])).otherwise(F.col(c)) for c in (*absent, *kept)}
        desc = desc.withColumns(filled)
    write_csv(desc.select(*DESCRIPTION.fieldNames()), out)
    return read_description(spark, out, index_column=False)


def feature_rows(enriched: Enriched) -> DataFrame:
    """All of it as rows ``(subreddit, feature, item, cnt)``."""
    desc = enriched.description

    def rows(df: DataFrame, feature: str, item, cnt: str) -> DataFrame:
        return df.select("subreddit", F.lit(feature).alias("feature"), item.alias("item"), F.col(cnt).alias("cnt"))

    nothing = F.lit("")
    tables = [
        rows(desc, "n_posts", nothing, "n_posts"),
        rows(desc, "n_comments", nothing, "n_comments"),
        rows(enriched.mentions, "mention", F.col("mention"), "cnt"),
        rows(enriched.ngrams, "ngram", F.col("ngram"), "cnt"),
        rows(enriched.domains, "domain", F.col("domain"), "cnt"),
    ]
    return reduce(DataFrame.unionByName, tables)


def description_with_maps(enriched: Enriched, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The description with its features as maps, one row per community.

    A community with more than ``max_entries`` items of a feature takes further rows, told
    apart by ``part``; these carry 0 posts and comments, so that totals still add up.
    """
    folded = {
        "external_links": fold_counts(enriched.domains, "subreddit", "domain", max_entries=max_entries),
        "sub_mentions": fold_counts(enriched.mentions, "subreddit", "mention", max_entries=max_entries),
        "ngrams": fold_counts(enriched.ngrams, "subreddit", "ngram", max_entries=max_entries),
    }
    first = enriched.description.withColumn("part", F.lit(0).cast("long"))
    for name, table in folded.items():
        first = first.join(table.withColumnRenamed("counts", name), ["subreddit", "part"], "full")
    empty = F.create_map().cast("map<string,bigint>")
    filled = first.fillna(0, ["n_posts", "n_comments"])
    return filled.select(
        "subreddit", "n_posts", "n_comments", *(F.coalesce(F.col(name), empty).alias(name) for name in folded), "part"
    )
