"""One Spark query per operator; each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmine.functions.links import domains, links
from postmine.functions.text import raw_tokens
from postmine.operators import corpus, dedupe, features, keywords, ranking, relations, summary, windows
from postmine.operators.groups import fold_counts
from postmine.operators.normalize import normalize_comments, normalize_posts
from postmine.plans import collect, enrich, grow
from postmine.session import scratch_dir
from postmine.sources.dumps import read_raw_comments, read_raw_posts
from postmine.sources.lists import read_authors, read_scopes, read_stopwords, read_terms, scopes_table
from postmine.sources.runs import compact, read_by_scope, save_by_scope
from postmine.sources.stored import read_comments, read_description, read_posts, stamp_from_path, title_from_path, write_csv, write_tables
from postmine.schemas import POST_COLUMNS
from suite import views as v

Query = Callable[[SparkSession, str], DataFrame]


def joined(items) -> F.Column:
    return F.array_join(items, " ")


def subreddit_counts(spark, folder):
    return summary.subreddit_counts(v.posts(spark, folder))


def description_left_join(spark, folder):
    return summary.describe(v.view(spark, folder, v.DESCRIPTION), v.posts(spark, folder))


def description_total(spark, folder):
    return summary.add_total(description_left_join(spark, folder))


def stored_posts(spark, folder):
    stored = v.posts(spark, folder).select(*POST_COLUMNS)
    return stored.withColumn("external_links", joined("external_links"))


def post_links(spark, folder, mode="strict"):
    raw = v.view(spark, folder, v.RAW_PAGES)
    body = F.translate("selftext", ";", ":")
    found = F.concat(*(F.arrays_zip(links(t, mode).alias("link"), domains(t, mode).alias("domain")) for t in (F.col("title"), body)))
    return raw.select(F.col("id").alias("post_id"), F.posexplode(found).alias("at", "hit")).select(
        "post_id", F.col("at").cast("long").alias("at"), "hit.link", "hit.domain"
    )


def post_links_compat(spark, folder):
    return post_links(spark, folder, "compat")


def domain_counts_by_post(spark, folder):
    return features.domain_counts(v.posts(spark, folder, v.RAW_PAGES), "post_id")


def domain_counts(spark, folder):
    return features.domain_counts(v.posts(spark, folder))


def domain_counts_compat(spark, folder):
    return features.domain_counts(v.posts(spark, folder, link_mode="compat"), link_mode="compat")


def corpus_lines(spark, folder):
    return corpus.corpus_lines(v.posts(spark, folder))


def corpus_lines_compat(spark, folder):
    return corpus.corpus_lines(v.posts(spark, folder), sub="src7", compat=True)


def corpus_by_subreddit(spark, folder):
    return corpus.corpus_by_subreddit(v.posts(spark, folder), max_chars=40_000)


def clean_text(spark, folder):
    cleaned = corpus.with_clean_text(v.posts(spark, folder), v.STOPWORDS, v.LEMMAS)
    return cleaned.select("post_id", "clean")


def benchmark_words(spark, folder):
    """Stopwords derived from the benchmark table."""
    words = v.table(spark, folder, "benchmark").select(F.explode(raw_tokens(F.col("text"))).alias("word"))
    return words.distinct()


def clean_tokens_with_tables(spark, folder):
    lemmas = spark.createDataFrame(list(v.LEMMAS.items()), "form string, lemma string")
    posts = v.posts(spark, folder)
    cleaned = corpus.with_clean_tokens(posts, benchmark_words(spark, folder), lemmas, inline_limit=0)
    return cleaned.select("post_id", joined("tokens").alias("tokens"))


def mentions(spark, folder):
    return features.mentions(v.posts(spark, folder), v.STOPWORDS, v.LEMMAS)


def raw_mentions(spark, folder):
    return features.raw_mentions(v.posts(spark, folder))


def frequent_ngrams(spark, folder):
    return features.frequent_ngrams(v.posts(spark, folder), v.STOPWORDS, v.LEMMAS)


def keyword_windows(spark, folder):
    return windows.keyword_windows(v.posts(spark, folder), v.KEYWORDS)


def keyword_windows_compat(spark, folder):
    return windows.keyword_windows(v.posts(spark, folder), v.KEYWORDS, compat=True)


def keyword_windows_with_table(spark, folder):
    terms = v.phrases(spark, folder).select(F.col("query").cast("int").alias("pos"), "term").distinct()
    return windows.keyword_windows(v.posts(spark, folder), terms, inline_limit=0)


def add_windows(spark, folder):
    found = windows.add_windows(v.posts(spark, folder), v.KEYWORDS)
    return found.select("post_id", F.array_join("window", "\n").alias("window"))


def keyword_bundles(spark, folder):
    terms = v.view(spark, folder, v.BUNDLED_TERMS)
    return keywords.bundle_terms(terms).unionByName(keywords.bundle_terms(terms, mode="singles"))


def matched(spark, folder):
    return keywords.match_keywords(v.posts(spark, folder), keywords.build_queries(v.KEYWORDS, "singles"), v.SCOPES)


def match_keywords(spark, folder):
    return matched(spark, folder).select("scope", "query", "post_id", "subreddit")


def match_bundle(spark, folder):
    found = keywords.match_keywords(v.posts(spark, folder), keywords.build_queries(v.KEYWORDS))
    return found.select("scope", "query", "post_id")


def all_scopes(spark, folder):
    """Every community, and everywhere."""
    named = v.table(spark, folder, "documents").select(F.col("source").alias("scope"))
    return named.union(scopes_table(spark, "all")).distinct()


def match_everything(spark, folder):
    found = keywords.match_keywords(v.posts(spark, folder), keywords.build_queries(""), all_scopes(spark, folder))
    return found.select("scope", "query", "post_id")


def match_phrase_table(spark, folder):
    found = keywords.match_keywords(v.posts(spark, folder), v.phrases(spark, folder), inline_limit=0)
    return found.select("query", "post_id")


def rows_per_scope(spark, folder):
    return keywords.rows_per_scope(matched(spark, folder), scopes_table(spark, v.SCOPES))


def newest_per_query(spark, folder):
    found = ranking.newest_per_group(matched(spark, folder), ["scope", "query"], 20)
    return found.select("scope", "query", "post_id", "date")


def top_per_query(spark, folder):
    found = ranking.newest_per_group(matched(spark, folder), ["scope", "query"], 20, "top")
    return found.select("scope", "query", "post_id", "score")


def top_of_year(spark, folder):
    return ranking.top_of_year(v.posts(spark, folder), v.AS_OF).select("post_id", "date", "score")


def comments_of_posts(spark, folder):
    posts = v.posts(spark, folder)
    return relations.comments_of(posts, v.comments(spark, folder))


def comments_per_subreddit(spark, folder):
    return relations.comments_per_subreddit(v.posts(spark, folder), v.comments(spark, folder))


def posts_of_authors(spark, folder):
    return relations.posts_of(v.posts(spark, folder), v.AUTHORS, 10).select("author", "post_id", "date")


def posts_of_flagged_authors(spark, folder):
    posts = v.posts(spark, folder)
    flagged = posts.filter(F.col("is_nsfw") & F.col("author").isNotNull()).select("author").distinct()
    return relations.posts_of(posts, flagged, lim=None).select("author", "post_id", "date")


def rows_per_author(spark, folder):
    found = collect.collect_author_posts(v.posts(spark, folder), v.AUTHORS, 10)
    return found.description


def domains_per_author(spark, folder):
    return collect.collect_author_posts(v.posts(spark, folder), v.AUTHORS, 10).domains


def append_rows(spark, folder):
    posts = v.posts(spark, folder)
    searched = keywords.match_keywords(posts, keywords.build_queries(v.KEYWORDS, "singles"))
    both = dedupe.append_rows(searched, relations.posts_of(posts, v.AUTHORS, lim=None))
    return both.groupBy("query").agg(F.count("*").alias("n_rows"), F.countDistinct("post_id").alias("n_posts"))


def remove_duplicates(spark, folder):
    return dedupe.remove_duplicates(matched(spark, folder)).select("post_id", "query", "date")


def remove_copies(spark, folder):
    return dedupe.remove_duplicates(v.posts(spark, folder, v.RAW_COPIES), by="content").select("post_id", "date")


def repeat_posts(spark, folder):
    return dedupe.repeat_posts(v.posts(spark, folder, v.RAW_COPIES)).select("author", "post_id")


def repeat_authors(spark, folder):
    return dedupe.repeat_authors(v.posts(spark, folder, v.RAW_COPIES))


def column_widths(spark, folder):
    # Lists and times are printed in the style of each engine, all else alike.
    return summary.column_widths(v.posts(spark, folder).drop("external_links", "created_at"))


def preview(spark, folder):
    best = ranking.preview(v.posts(spark, folder), ranking.post_order("top"))
    return best.select("subreddit", "title", F.col("body").alias("content"), F.col("score").alias("upvotes"),
                       F.col("up_ratio").alias("upvote_ratio"), "n_comments")


def dataset_size(spark, folder):
    return summary.dataset_size(v.posts(spark, folder))


def collect_search(spark, folder):
    found = collect.collect_posts(v.posts(spark, folder), v.SCOPES, v.KEYWORDS, lim=50, query_mode="singles")
    return found.posts.select("scope", "query", "post_id")


def collect_search_description(spark, folder):
    found = collect.collect_posts(v.posts(spark, folder), v.SCOPES, v.KEYWORDS, lim=50, query_mode="singles")
    return found.description


def collect_search_domains(spark, folder):
    found = collect.collect_posts(v.posts(spark, folder), v.SCOPES, v.KEYWORDS, lim=50, query_mode="singles")
    return found.domains


def collect_top(spark, folder):
    found = collect.collect_posts(v.posts(spark, folder), all_scopes(spark, folder), mode="top", as_of=v.AS_OF)
    return found.posts.select("scope", "post_id", "score")


def collect_new(spark, folder):
    return collect.collect_posts(v.posts(spark, folder), v.SCOPES, mode="new", lim=15).posts.select("scope", "post_id")


def _enriched(spark, folder):
    return enrich.enrich(
        v.view(spark, folder, v.DESCRIPTION), v.posts(spark, folder), v.STOPWORDS, v.LEMMAS, v.comments(spark, folder)
    )


def enriched_description(spark, folder):
    return enrich.feature_rows(_enriched(spark, folder))


def description_map_entries(spark, folder):
    """The map form of the description, opened up again."""
    maps = enrich.description_with_maps(_enriched(spark, folder), max_entries=40)
    opened = [
        maps.select("subreddit", F.lit(name).alias("feature"), F.explode(name).alias("item", "cnt"))
        for name in ("external_links", "sub_mentions", "ngrams")
    ]
    return opened[0].unionByName(opened[1]).unionByName(opened[2])


def folded_domains(spark, folder):
    counts = features.domain_counts(v.posts(spark, folder, v.RAW_PAGES), "post_id")
    folded = fold_counts(counts, "post_id", "domain", max_entries=2)
    return folded.select("post_id", "part", F.explode("counts").alias("domain", "cnt"))


def csv_round_trip(spark, folder):
    path = _scratch(spark, "posts")
    write_csv(normalize_posts(v.view(spark, folder, v.RAW_POSTS)).select(*POST_COLUMNS), path)
    back = read_posts(spark, path, index_column=False)
    return back.withColumn("external_links", joined("external_links")).drop("created_at")


def _scratch(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def comments_round_trip(spark, folder):
    path = _scratch(spark, "comments")
    write_csv(v.comments(spark, folder), path)
    return read_comments(spark, path, index_column=False)


def description_round_trip(spark, folder, max_entries=enrich.MAX_ENTRIES):
    path = _scratch(spark, "description")
    write_csv(enrich.description_with_maps(_enriched(spark, folder), max_entries), path)
    return _opened(read_description(spark, path, index_column=False))


def _opened(description):
    """A stored description as one row per count."""
    opened = [
        description.select("subreddit", F.lit(name).alias("feature"), F.explode(name).alias("item", "cnt"))
        for name in ("external_links", "sub_mentions", "ngrams")
    ]
    posts = description.filter("part = 0").select("subreddit", F.lit("n_posts").alias("feature"), F.lit("").alias("item"), F.col("n_posts").alias("cnt"))
    return dedupe.append_rows(posts, *opened)


def reload_and_enrich(spark, folder, max_entries=enrich.MAX_ENTRIES):
    """A stored collection whose description holds names alone, read again and completed."""
    posts, description, out = (_scratch(spark, name) for name in ("posts", "description", "enriched"))
    write_csv(v.posts(spark, folder).select(*POST_COLUMNS), posts)
    write_csv(v.view(spark, folder, v.DESCRIPTION), description)
    return _opened(enrich.reload_and_enrich(spark, posts, description, ["subreddit"], out, v.STOPWORDS, v.LEMMAS, max_entries=max_entries))


def mentions_of_all(spark, folder):
    return features.mentions_of_all(v.view(spark, folder, v.DESCRIPTION), mentions(spark, folder))


def collected_comments(spark, folder):
    found = collect.collect_posts(
        v.posts(spark, folder), v.SCOPES, v.KEYWORDS, lim=50, query_mode="singles", comments=v.comments(spark, folder)
    )
    return found.comments


def saved_by_scope(spark, folder):
    path = _scratch(spark, "scopes")
    save_by_scope(matched(spark, folder), path)
    return read_by_scope(spark, path, "scope string, query string, post_id string")


def saved_twice(spark, folder):
    """A second run over the same scopes, in which one of them has no posts any more."""
    path, asked = _scratch(spark, "scopes"), scopes_table(spark, v.SCOPES)
    save_by_scope(matched(spark, folder), path, asked=asked)
    save_by_scope(matched(spark, folder).filter("scope <> 'src1'"), path, asked=asked)
    return read_by_scope(spark, path, "scope string, query string, post_id string")


def saved_and_compacted(spark, folder):
    """A collection saved scope by scope, the last run again, then written as one run."""
    path, found = _scratch(spark, "runs"), matched(spark, folder)
    schema = found.schema
    save_by_scope(found.filter("scope = 'all'"), path)
    save_by_scope(found.filter("scope <> 'all'").limit(0), path, asked=scopes_table(spark, ["src1", "src3"]))
    save_by_scope(found.filter("scope <> 'all'"), path)
    compact(spark, path, schema)
    return read_by_scope(spark, path, schema).select("scope", "query", "post_id")


def saved_collections(spark, folder):
    """What the names of saved tables tell, and how many rows they hold."""
    path = _scratch(spark, "saved")
    tables = {"posts": v.posts(spark, folder), "description": v.view(spark, folder, v.DESCRIPTION), "comments": v.comments(spark, folder)}
    paths = write_tables(path, "forum", datetime(2025, 1, 20, 7, 5, 9), **tables)
    found = [
        spark.read.parquet(p).select(F.lit(name).alias("stored"), F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("path"))
        for name, p in paths.items()
    ]
    rows = dedupe.append_rows(*found)
    return rows.groupBy("stored", title_from_path(F.col("path")).alias("title"), stamp_from_path(F.col("path")).alias("stamp")).agg(F.count("*").alias("n_rows"))


def _text_file(spark, name, lines):
    path = _scratch(spark, name)
    lines.write.text(path)
    return path


def _ordered_text(spark, name, df, line, *order):
    """The lines of ``df`` in order, over several files."""
    return _text_file(spark, name, df.repartitionByRange(4, *order).sortWithinPartitions(*order).select(line))


def part_names(spark, folder):
    return _ordered_text(spark, "names", v.table(spark, folder, "part"), "p_name", "p_partkey")


def terms_by_line(spark, folder):
    return read_terms(spark, part_names(spark, folder)).select(F.col("pos").cast("long").alias("pos"), "term")


def terms_by_word(spark, folder):
    return read_terms(spark, part_names(spark, folder), by="word").select(F.col("pos").cast("long").alias("pos"), "term")


def scope_file(spark, folder):
    return read_scopes(spark, _text_file(spark, "scopes", v.table(spark, folder, "documents").select("source")))


def author_file(spark, folder):
    path = _scratch(spark, "authors")
    v.posts(spark, folder).select(F.col("author").alias("authors")).write.option("header", True).csv(path)
    return read_authors(spark, path)


def search_from_file(spark, folder):
    """A keyword file, bundled and searched everywhere, without a limit."""
    phrases = v.phrases(spark, folder).select(F.col("query").cast("long").alias("item"), "place", F.translate("term", "\n", " ").alias("term"))
    path = _ordered_text(spark, "phrases", phrases, "term", "item", "place")
    found = collect.collect_posts(v.posts(spark, folder), "all", read_terms(spark, path), lim=None)
    return found.posts.select("scope", "query", "post_id")


def posts_from_dump(spark, folder):
    path = _scratch(spark, "dump")
    v.view(spark, folder, v.RAW_POSTS).write.json(path)
    stored = normalize_posts(read_raw_posts(spark, path)).select(*POST_COLUMNS)
    return stored.withColumn("external_links", joined("external_links"))


def comments_from_dump(spark, folder):
    path = _scratch(spark, "dump")
    v.view(spark, folder, v.RAW_COMMENTS).write.json(path)
    return normalize_comments(read_raw_comments(spark, path))


def broken_dump(spark, folder):
    """A dump in which two lines of seven are broken, and what became of them."""
    path, aside = _scratch(spark, "dump"), _scratch(spark, "aside")
    raw = v.view(spark, folder, v.RAW_POSTS)
    line = F.to_json(F.struct(*raw.columns))
    kind = F.col("id").cast("long") % 7
    # Cut short, or with a text where a number belongs; the id stands first either way.
    broken = F.when(kind == 0, F.expr("left(line, length(line) - 1)")).when(kind == 1, F.replace("line", F.lit('"num_comments":'), F.lit('"num_comments":"x","y":')))
    raw.select("id", line.alias("line")).select(F.coalesce(broken, "line").alias("value")).write.text(path)
    kept = read_raw_posts(spark, path, quarantine=aside).select(F.col("id").alias("post_id"), F.lit("kept").alias("state"))
    lost = spark.read.schema("file string, value string").json(aside)
    return kept.union(lost.select(F.regexp_extract("value", '"id":"([0-9]+)"', 1), F.lit("set aside")))


def grown_counts(spark, folder):
    """Three dumps one after the other, with repeats in and across them."""
    path, posts = _scratch(spark, "grown"), v.posts(spark, folder)
    turn = F.col("post_id").cast("long") % 3
    for some in (posts.filter(turn == 0).union(posts.filter(turn == 0)), posts.filter(turn <= 1), posts):
        grow.add_dump(some, path, v.STOPWORDS, v.LEMMAS)
    return grow.grown_features(spark, path)


def ngram_report(spark, folder):
    return features.ngram_report(frequent_ngrams(spark, folder))


def stopword_file(spark, folder):
    path = _scratch(spark, "words")
    benchmark_words(spark, folder).withColumnRenamed("word", "value").write.text(path)
    return read_stopwords(spark, path)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        subreddit_counts, description_left_join, description_total, stored_posts, post_links, post_links_compat,
        domain_counts_by_post, domain_counts, domain_counts_compat, corpus_lines, corpus_lines_compat,
        corpus_by_subreddit, clean_text, clean_tokens_with_tables, mentions, raw_mentions, frequent_ngrams,
        keyword_windows, keyword_windows_compat, keyword_windows_with_table, add_windows, keyword_bundles,
        match_keywords, match_bundle, match_everything, match_phrase_table, rows_per_scope, newest_per_query,
        top_per_query, top_of_year, comments_of_posts, comments_per_subreddit, posts_of_authors,
        posts_of_flagged_authors, rows_per_author, domains_per_author, append_rows, remove_duplicates, remove_copies,
        repeat_posts, repeat_authors, column_widths, preview, dataset_size, collect_search,
        collect_search_description, collect_search_domains, collect_top, collect_new, enriched_description,
        description_map_entries, folded_domains, csv_round_trip, comments_round_trip, description_round_trip,
        saved_by_scope, saved_twice, stopword_file, terms_by_line, terms_by_word, scope_file, author_file,
        search_from_file, saved_and_compacted, saved_collections, broken_dump, grown_counts,
        posts_from_dump, comments_from_dump, ngram_report,
        reload_and_enrich, mentions_of_all, collected_comments,
    )
}
QUERIES["normalize_posts"] = QUERIES.pop("stored_posts")
