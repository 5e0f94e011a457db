"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

log P(language | all) = text likelihood + P(declared | language) + prior of the host. The prior of a host is smoothed
towards that of its address suffix, and that towards all rows; both come from grouped counts over the whole table.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmine.llm.rows import map_batches, settle

#: Labelled documents that train the text model, per language. Scoring has no bound.
TRAINING_DOCUMENTS = 300
#: Byte trigrams fall into so many cells.
CELLS = 1 << 16
#: How many rows of its own a prior needs to count as much as the one above it.
HOST_STRENGTH, SUFFIX_STRENGTH = 10.0, 50.0
DECLARED_STRENGTH = 1.0
#: Trigrams overlap and are far from independent; the share that counts is chosen among these on held-out rows.
TEMPERS = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01)

TAGS = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def _cells(text: bytes) -> np.ndarray:
    data = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    return ((data[:-2] * np.uint32(961) + data[1:-1] * np.uint32(31) + data[2:]) * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class TextModel:
    """Log-likelihood of a trigram cell by language, and the share of the sum that counts."""

    languages: list[str]
    table: np.ndarray
    temper: float

    def scores(self, text: bytes) -> np.ndarray:
        """One score per language, tempered; zeros for a text of under two bytes."""
        if len(text) < 2:
            return np.zeros(len(self.languages))
        total = np.zeros(len(self.languages))
        for i in range(0, len(text), 1 << 20):
            total += self.table[_cells(text[i : i + (1 << 20) + 2])].sum(0, dtype=np.float64)
        return total * self.temper


def fit_text(rows: list[tuple[str, bytes]]) -> TextModel:
    """Naive Bayes over trigrams: half of the rows fill the table, the other half chooses the temper, then all fill it."""
    languages = sorted({x for x, _ in rows})

    def table(some) -> np.ndarray:
        counts = np.full((CELLS, len(languages)), 0.05)
        for language, text in some:
            counts[:, languages.index(language)] += np.bincount(_cells(text), minlength=CELLS)
        return np.log(counts / counts.sum(0)).astype(np.float32)

    model = TextModel(languages, table(rows[::2]), 1.0)
    held = [(languages.index(x), model.scores(t)) for x, t in rows[1::2]]

    def loss(temper: float) -> float:
        return sum(np.logaddexp.reduce(s * temper) - s[i] * temper for i, s in held)

    temper = min(TEMPERS, key=loss) if held else 1.0
    return TextModel(languages, table(rows), temper)


def fit_language_text(docs: DataFrame, sample: int = TRAINING_DOCUMENTS) -> TextModel | None:
    """The text model from at most ``sample`` documents of each language of ``docs``; None where none has a language.

    All languages count and texts are read whole. Of each language the documents with the least hash of their id are taken.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang").distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # At most sample ids per language, cut before the shuffle.
    wanted = known.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= sample).select("doc_id", "lang").collect()
    if not wanted:
        return None
    ids = F.broadcast(docs.sparkSession.createDataFrame(wanted, "doc_id long, lang string"))
    found = docs.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted((r.lang, r.doc_id, r.text) for r in found.collect())
    return fit_text([(lang, text.encode()) for lang, _, text in rows])


EVIDENCE = ["doc_id", "page_id", "host", "suffix", "declared", "text", "markup"]


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as rows of evidence: host and suffix of the url, the language that the html element declares."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    tag = F.regexp_extract("html", r"(?i)<html\b([^>]*)>", 1)
    declared = F.nullif(F.lower(F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"),
        F.substring_index(host, ".", -1).alias("suffix"), declared.alias("declared"), F.col("html").alias("text"), F.lit(True).alias("markup"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents as rows of evidence: their source is their host, and nothing is declared."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.lower("source").alias("host"),
        none.alias("suffix"), none.alias("declared"), "text", F.lit(False).alias("markup"),
    )


def _text_scores(rows: DataFrame, model: TextModel) -> DataFrame:
    def each(batch: pa.RecordBatch) -> dict:
        scores = []
        for text, markup in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("markup").to_pylist()):
            data = text or b""
            if markup:
                data = html.unescape(TAGS.sub(b" ", data).decode(errors="ignore")).encode()
            scores.append(model.scores(b" ".join(data.split())).tolist())
        return {name: batch.column(name) for name in EVIDENCE[:5]} | {"scores": scores}

    return map_batches(rows.select(*EVIDENCE), each, "doc_id long, page_id long, host string, suffix string, declared string, scores array<double>")


def _counts(first: str, languages: list[str]) -> Column:
    return F.array(*(F.sum(F.when(F.col(first) == i, 1.0).otherwise(0.0)) for i in range(len(languages))))


def _smoothed(counts: Column | str, above: Column, strength: float) -> Column:
    """Shares by counts, drawn to those above by ``strength`` rows."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + strength
    return F.zip_with(counts, above, lambda n, p: (n + strength * p) / total)


def identify(rows: DataFrame, model: TextModel | None) -> DataFrame:
    """doc_id, page_id, lang, posterior, and what text and declaration say alone, for every row of evidence.

    A null or empty text says nothing; a row without host takes the prior of its suffix, without suffix that of all
    rows. Of equally likely languages the first in order wins. Without a model (no labelled text), lang is null.
    """
    if model is None:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("posterior"), none.alias("text_lang"), "declared")
    languages, n = model.languages, len(model.languages)
    scored = _text_scores(rows, model).withColumn("first", F.array_position("scores", F.array_max("scores")).cast("int") - 1)
    scored = settle(scored, "language-scores")
    # First guesses by text alone are counted; texts that say nothing are not.
    counted = scored.filter(F.array_max("scores") != F.array_min("scores"))
    total = np.array((counted.agg(_counts("first", languages).alias("n")).first() or [None])[0] or [0.0] * n, float)
    overall = ((np.nan_to_num(total) + 1) / (np.nan_to_num(total).sum() + n)).tolist()
    named = F.when(F.col("declared").isin(languages), F.col("declared")).otherwise("other")
    pairs = counted.filter("declared IS NOT NULL").groupBy("first", named.alias("declared")).count().collect()
    confusion = np.full((n, n + 1), DECLARED_STRENGTH / (n + 1))
    for r in pairs:
        confusion[r["first"], languages.index(r.declared) if r.declared in languages else n] += r["count"]
    confusion = np.log(confusion / confusion.sum(1, keepdims=True))
    kinds = F.create_map(*(x for k, name in enumerate([*languages, "other"]) for x in (F.lit(name), F.array(*map(F.lit, confusion[:, k].tolist())))))
    prior = F.array(*map(F.lit, overall))

    hosts = counted.filter("host IS NOT NULL").groupBy("suffix", "host").agg(_counts("first", languages).alias("counts"))
    parts = F.array(*(F.sum(F.col("counts")[i]) for i in range(n)))
    suffixes = hosts.filter("suffix IS NOT NULL").groupBy("suffix").agg(parts.alias("of_suffix"))
    suffixes = suffixes.select("suffix", _smoothed("of_suffix", prior, SUFFIX_STRENGTH).alias("of_suffix"))
    hosts = hosts.join(suffixes, "suffix", "left").select(
        "host", "counts", F.coalesce("of_suffix", prior).alias("above"), F.col("suffix").alias("host_suffix")
    )
    # Rows of a hot host are spread by the join itself, which splits large partitions.
    joined = scored.join(hosts, (scored.host == hosts.host) & scored.suffix.eqNullSafe(hosts.host_suffix), "left").drop(hosts.host)
    joined = joined.join(suffixes, "suffix", "left")
    # The guess of a row itself is no vote for its host.
    speaks = (F.array_max("scores") != F.array_min("scores")).cast("int")
    others = F.transform("counts", lambda c, i: c - F.when(i == F.col("first"), speaks).otherwise(0))
    joined = joined.withColumn("of_host", F.when(F.col("counts").isNotNull(), _smoothed(others, F.col("above"), HOST_STRENGTH)))
    with_prior = F.zip_with("scores", F.coalesce("of_host", "of_suffix", prior), lambda s, p: s + F.log(p))
    said = F.when(F.col("declared").isNotNull(), kinds[named])
    joined = joined.withColumn("sum", F.when(said.isNull(), with_prior).otherwise(F.zip_with(with_prior, said, lambda s, d: s + d)))
    top = F.array_max("sum")
    weight = F.aggregate("sum", F.lit(0.0), lambda a, s: a + F.exp(s - F.array_max("sum")))
    name = F.array(*map(F.lit, languages))
    text_lang = F.when(F.array_max("scores") != F.array_min("scores"), name[F.col("first")])
    return joined.select(
        "doc_id", "page_id", name[F.array_position("sum", top).cast("int") - 1].alias("lang"), (1 / weight).alias("posterior"),
        text_lang.alias("text_lang"), "declared",
    )
