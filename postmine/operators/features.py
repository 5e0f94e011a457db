"""Countable features of posts, per community.

All features come out of one scan and one shuffle: a post becomes entries
of some kind and these are counted per community. Frequent n-grams take a
scan of the cleaned words before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmine.functions.bits import BitField, bit_field
from postmine.functions.links import domain_of
from postmine.functions.text import MIN_CLEAN_TOKENS, clean_text, corpus_line, ngram_words, ngrams, words
from postmine.operators.corpus import with_clean_tokens
from postmine.operators.numbering import total_before
from postmine.operators.summary import subreddit_counts
from postmine.session import written

# Fixed values.
MENTION = "r/"
MIN_COUNT = 7
NGRAM_SIZES = (3, 5)
MIN_POSTS = 3

# An entry is a letter for its kind, followed by the item.
KINDS = {"post": "p", "gate": "t", "mention": "m", "ngram": "g", "domain": "d"}


def _each(kind: str, items: Column) -> Column:
    return F.transform(items, lambda item: F.concat(F.lit(KINDS[kind]), item))


def stored_links() -> Column:
    return F.coalesce(F.col("external_links"), F.array().cast("array<string>"))


def starts_mention(token: Column) -> Column:
    return F.startswith(token, F.lit(MENTION))


def feature_counts(
    posts: DataFrame,
    kinds: Sequence[str] = tuple(KINDS),
    stopwords: DataFrame | Sequence[str] = (),
    lemmas: DataFrame | Mapping[str, str] | None = None,
    sizes: tuple[int, int] = NGRAM_SIZES,
    link_mode: str = "strict",
    compat: bool = False,
    least_ngrams: int = 1,
) -> DataFrame:
    """Rows ``(subreddit, kind, item, cnt)``; posts without a community are left out.

    N-grams that a community has less than ``least_ngrams`` times are left out; above 1, longer ones are only made where
    all the shortest in them are frequent, see :func:`frequent_runs`.

    ``post`` and ``gate`` have a blank item. ``gate`` is no count of tokens: a post adds at most
    ``MIN_CLEAN_TOKENS`` to it, enough to tell whether its community has that many. Domains are those of the stored
    ``external_links``.
    """
    found = posts.filter(F.col("subreddit").isNotNull())
    if {"gate", "mention", "ngram"} & set(kinds):
        found = with_clean_tokens(found, stopwords, lemmas, compat=compat)
    if "ngram" in kinds:
        found = found.withColumn("_words", ngram_words(clean_text(F.col("tokens"))))
    some = F.least(F.size("tokens"), F.lit(MIN_CLEAN_TOKENS)) if "tokens" in found.columns else None
    parts = {
        "post": lambda: F.array(F.lit(KINDS["post"])),
        "gate": lambda: F.array_repeat(F.lit(KINDS["gate"]), some),
        "mention": lambda: _each("mention", F.filter("tokens", starts_mention)),
        "ngram": lambda: ngrams(F.col("_words"), *sizes, prefix=KINDS["ngram"]),
        "domain": lambda: _each("domain", F.transform(stored_links(), lambda x: domain_of(x, link_mode))),
    }
    if "ngram" in kinds and least_ngrams > 1:
        # Texts are cleaned once; counting first and making n-grams after both read the words.
        others = F.concat(*(parts[kind]() for kind in kinds if kind != "ngram")) if len(kinds) > 1 else F.array().cast("array<string>")
        found = written(found.select("subreddit", "_words", others.alias("_others")), "words")
        rows = _ngrams_of_runs(found, sizes, frequent_runs(found, sizes[0], least_ngrams))
        if len(kinds) > 1:
            rows = rows.union(found.select("subreddit", F.explode("_others").alias("_entry")))
    else:
        entries = F.concat(*(parts[kind]() for kind in kinds))
        rows = found.select("subreddit", F.explode(entries).alias("_entry"))
    counts = [F.count("*").alias("cnt")]
    if len(kinds) > 1:
        # The kind as an aggregate: a filter on it is then not moved below the shuffle, and all
        # readers of the counts share one scan.
        counts.append(F.max(F.ascii("_entry")).alias("_letter"))
    letter = F.char("_letter") if len(kinds) > 1 else F.substring("_entry", 1, 1)
    names = F.create_map(*(F.lit(x) for kind in KINDS for x in (KINDS[kind], kind)))
    counted = rows.groupBy("subreddit", "_entry").agg(*counts).select(
        "subreddit", names[letter].alias("kind"), F.substr("_entry", F.lit(2)).alias("item"), "cnt"
    )
    return counted if least_ngrams <= 1 else counted.filter((F.col("kind") != "ngram") | (F.col("cnt") >= least_ngrams))


def _runs(posts: DataFrame, size: int) -> DataFrame:
    """A row for each run of ``size`` words of ``_words``, with its place ``_at``."""
    last = F.size("_words") - size
    return posts.filter(last >= 0).select("subreddit", "_words", F.explode(F.sequence(F.lit(0), last)).alias("_at"))


def _run_sum(size: int, at: Column) -> Column:
    """A checksum of the ``size`` words from place ``at`` on, seeded by the community."""
    return F.xxhash64("subreddit", *(F.get("_words", at + k) for k in range(size)))


def frequent_runs(posts: DataFrame, size: int, least: int) -> BitField:
    """The checksums of the runs of ``size`` words of ``_words`` that may be frequent in their community.

    Runs are counted by checksum, 16 bytes instead of their text, and the frequent ones travel in the plan as a field of
    bits. Every n-gram of ``least`` posts or more is found in it at all its places, as each run in it is at least as
    frequent; a run that is not frequent may pass as well, so n-grams are counted again by text.
    """
    sums = _runs(posts, size).select(_run_sum(size, F.col("_at")).alias("_sum")).groupBy("_sum").agg(F.count("*").alias("_n"))
    return bit_field(sums.filter(F.col("_n") >= least).select("_sum"))


def frequent_starts(posts: DataFrame, size: int, least: int) -> Column:
    """For each word of ``_words`` whether the ``size`` words from it on are in :func:`frequent_runs`."""
    field = frequent_runs(posts, size, least)
    last = F.size("_words") - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: field.has(_run_sum(size, i)))


def _ngrams_of_runs(posts: DataFrame, sizes: tuple[int, int], field: BitField) -> DataFrame:
    """Rows ``(subreddit, _entry)``: the n-grams of ``_words`` all of whose shortest runs are in ``field``.

    Places and n-grams are rows, not lists, so that they are made by compiled code.
    """
    low, high = sizes
    started = _runs(posts, low).filter(field.has(_run_sum(low, F.col("_at"))))
    reached, found = F.lit(True), []
    for n in range(low, high + 1):
        if n > low:
            reached &= (F.size("_words") >= F.col("_at") + n) & field.has(_run_sum(low, F.col("_at") + (n - low)))
        words = [F.get("_words", F.col("_at") + k) for k in range(n)]
        found.append(F.when(reached, F.concat_ws(" ", F.concat(F.lit(KINDS["ngram"]), words[0]), *words[1:])))
    return started.select("subreddit", F.explode(F.array(*found)).alias("_entry")).filter("_entry IS NOT NULL")


def _of_kind(counts: DataFrame, kind: str, name: str) -> DataFrame:
    return counts.filter(F.col("kind") == kind).select("subreddit", F.col("item").alias(name), "cnt")


def _admitted(counts: DataFrame, kind: str, least: int) -> DataFrame:
    return counts.filter((F.col("kind") == kind) & (F.col("cnt") >= least)).select("subreddit")


def mentions_of(counts: DataFrame) -> DataFrame:
    """Mention counts out of :func:`feature_counts` with kinds ``mention`` and ``gate``.

    A community whose whole text keeps two tokens or fewer has none.
    """
    admitted = _admitted(counts, "gate", MIN_CLEAN_TOKENS)
    return _of_kind(counts, "mention", "mention").join(admitted, "subreddit", "left_semi")


def mentions_of_all(desc: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions of every community of ``desc``; one that mentions nobody has a row without a mention, counted 0."""
    return desc.select("subreddit").distinct().join(mentions, "subreddit", "left").fillna(0, ["cnt"])


def ngrams_of(counts: DataFrame, n_posts: DataFrame, lim: int = MIN_COUNT, min_posts: int = MIN_POSTS) -> DataFrame:
    """Frequent n-grams out of :func:`feature_counts` with kind ``ngram``.

    The size of a community, from ``n_posts``, is tested on the few frequent rows, not on the posts.
    """
    frequent = _of_kind(counts, "ngram", "ngram").filter(F.col("cnt") >= lim)
    large = n_posts.filter(F.col("n_posts") >= min_posts).select("subreddit")
    return frequent.join(large, "subreddit", "left_semi")


def domains_of(counts: DataFrame) -> DataFrame:
    """Domain counts out of :func:`feature_counts` with kind ``domain``."""
    return _of_kind(counts, "domain", "domain")


def mentions(
    posts: DataFrame,
    stopwords: DataFrame | Sequence[str] = (),
    lemmas: DataFrame | Mapping[str, str] | None = None,
) -> DataFrame:
    """How often each community mentions another in its cleaned text."""
    # Mentions and the gate both read the counts.
    return mentions_of(written(feature_counts(posts, ("gate", "mention"), stopwords, lemmas), "mentions"))


def raw_mentions(posts: DataFrame) -> DataFrame:
    """The same counts on the text as it is: case and underscores are kept."""
    found = posts.filter(F.col("subreddit").isNotNull())
    tokens = F.filter(words(corpus_line(F.col("title"), F.col("body"))), starts_mention)
    return found.select("subreddit", F.explode(tokens).alias("mention")).groupBy("subreddit", "mention").agg(
        F.count("*").alias("cnt")
    )


def frequent_ngrams(
    posts: DataFrame,
    stopwords: DataFrame | Sequence[str] = (),
    lemmas: DataFrame | Mapping[str, str] | None = None,
    lim: int = MIN_COUNT,
    sizes: tuple[int, int] = NGRAM_SIZES,
    min_posts: int = MIN_POSTS,
) -> DataFrame:
    """N-grams that occur ``lim`` times or more in communities of ``min_posts`` posts or more."""
    counts = feature_counts(posts, ("ngram",), stopwords, lemmas, sizes, least_ngrams=lim)
    # Counting posts reads one narrow column once more.
    return ngrams_of(counts, subreddit_counts(posts), lim, min_posts)


def ngram_report(ngrams: DataFrame) -> DataFrame:
    """N-grams by count, then by text, both falling, within each community, with their ``rank`` from 1.

    Ranks are counted by ranges, so a community with most of the n-grams is no single group.
    """
    order = [F.desc("cnt"), F.desc("ngram")]
    before = total_before(ngrams, order, by=["subreddit"], name="rank")
    return before.withColumn("rank", F.col("rank") + 1).orderBy("subreddit", "rank")


def domain_counts(posts: DataFrame, by: str = "subreddit", link_mode: str = "strict") -> DataFrame:
    """Domains of the stored links, counted per community, post, author or scope."""
    links = posts.filter(F.col(by).isNotNull()).select(by, F.explode("external_links").alias("link"))
    domain = domain_of(F.col("link"), link_mode).alias("domain")
    return links.groupBy(by, domain).agg(F.count("*").alias("cnt"))
