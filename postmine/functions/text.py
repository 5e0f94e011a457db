"""Corpus lines, cleaning and tokens."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmine.functions.expr import let, lookup

# They decide which results come out.
# White space as str.split() and str.strip() see it, for use inside a character class.
SPACE_CLASS = r"\x09-\x0d\x1c-\x20\x85\p{Z}"
# The same characters one by one, for trimming.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Punctuation that cleaning turns into a space: . ? ! , ; : - \ ( ) _ '
PUNCTUATION_CLASS = r".?!,;:\-\\()_'"
# Characters that the tokenizer sets apart as tokens of their own.
SINGLE_CLASS = "@#$%&*\\[\\]{}<>\"`«»“”‘’„"
# A word of the n-gram counter: two or more word characters.
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
NEWLINE_MARK = "<newline>"
MISSING_TEXT = "nan"
MIN_CLEAN_TOKENS = 3

TOKEN_PATTERN = f"[{SINGLE_CLASS}]|[^{SPACE_CLASS}{PUNCTUATION_CLASS}{SINGLE_CLASS}]+"
GAP_PATTERN = f"[{SPACE_CLASS}{PUNCTUATION_CLASS}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Words between white space; ``[""]`` for blank text."""
    return F.split(strip(text), f"[{SPACE_CLASS}]+")


def tidy(text: Column) -> Column:
    """Newline marks and tabs to spaces, runs of spaces to one, ends stripped."""
    spaced = F.replace(F.replace(text, F.lit(NEWLINE_MARK), F.lit(" ")), F.lit("\t"), F.lit(" "))
    # Few texts have two spaces in a row; the others are spared the pattern.
    return let(spaced, lambda one: strip(F.when(F.contains(one, F.lit("  ")), F.regexp_replace(one, " {2,}", " ")).otherwise(one)))


def corpus_line(title: Column, body: Column, compat: bool = False) -> Column:
    """One post as one line. Missing text counts as empty, with ``compat`` as "nan"."""
    missing = F.lit(MISSING_TEXT if compat else "")
    return tidy(F.concat_ws(" ", F.coalesce(title, missing), F.coalesce(body, missing)))


def raw_tokens(text: Column) -> Column:
    """Lower-case tokens; the cleaned punctuation never shows up in them.

    A text without characters that are set apart, as most are, is cut where tokens end, which takes half the time.
    """

    def tokens(low: Column) -> Column:
        pieces = F.filter(F.split(low, GAP_PATTERN), lambda piece: piece != "")
        return F.when(F.rlike(low, F.lit(f"[{SINGLE_CLASS}]")), F.regexp_extract_all(low, F.lit(TOKEN_PATTERN), F.lit(0))).otherwise(pieces)

    return let(F.lower(text), tokens)


def clean_tokens(
    text: Column,
    stopwords: Iterable[str] = (),
    lemmas: Mapping[str, str] | None = None,
) -> Column:
    """Tokens without stopwords, each replaced by its lemma where one is known."""
    stop = sorted(set(stopwords))
    kept = raw_tokens(text)
    if stop:
        kept = F.filter(kept, lambda token: ~token.isin(stop))
    if lemmas:
        kept = F.transform(kept, lambda token: lookup(token, lemmas))
    return kept


def clean_text(tokens: Column) -> Column:
    """Cleaned tokens as text; blank if two or fewer survive."""
    enough = F.size(tokens) >= MIN_CLEAN_TOKENS
    return F.when(enough, F.array_join(tokens, " ")).otherwise(F.lit(""))


def ngram_words(text: Column) -> Column:
    """Words of two or more word characters; cut between words, which takes less time than finding them."""
    return F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda word: F.length(word) >= 2)


def ngrams(tokens: Column, low: int = 3, high: int = 5, prefix: str = "", starts: Column | None = None) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, as space-joined text after ``prefix``.

    With ``starts``, a boolean for each run of ``low`` tokens, only those n-grams whose runs are all marked.
    """

    def start(word: Column) -> Column:
        return F.concat(F.lit(prefix), word) if prefix else word

    def of_size(words: Column, n: int) -> Column:
        last = F.size(words) - n
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        if starts is not None:
            places = F.filter(places, lambda i: reduce(Column.__and__, (F.get(starts, i + k) for k in range(n - low + 1))))
        return F.transform(places, lambda i: F.concat_ws(" ", start(F.get(words, i)), *(F.get(words, i + k) for k in range(1, n))))

    return let(tokens, lambda words: F.concat(*(of_size(words, n) for n in range(low, high + 1))))
