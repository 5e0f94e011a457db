"""Quality rules: word and line rules, then a chain model that tells content lines from boilerplate."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmine.llm.pieces import pieces
from postmine.llm.rows import map_batches

#: Bounds of the training sample: labelled documents per class, and lines and characters of each. Scoring has no bound.
TRAINING_DOCUMENTS = 600
TRAINING_LINES = 60
TRAINING_CHARS = 20_000
#: A document is kept if at least this share of its words stands in content lines.
CONTENT_SHARE = 0.5

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
#: Shares of a line are put into the bins between these edges.
EDGES = np.array([0.0005, 0.01, 0.03, 0.08, 0.2, 0.5])
LENGTHS = np.array([2, 4, 8, 16, 32, 64, 128])
N_SHARES = 7
N_FEATURES = 2 + N_SHARES * (len(EDGES) + 1) + len(LENGTHS) + 1

#: So many texts of a batch are Python strings, and are sent back, at a time.
TEXTS_AT_ONCE = 500
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_content_lines long, content_share double, base_failed boolean, kept boolean"
)


@dataclass
class LineChain:
    """A linear chain of two labels, 1 for content: weights of the features for label 1, and of label pairs."""

    weights: np.ndarray
    pairs: np.ndarray

    @classmethod
    def blank(cls) -> LineChain:
        """Without training every line is content."""
        return cls(np.eye(1, N_FEATURES)[0], np.zeros((2, 2)))


def line_features(lines: list[bytes]) -> np.ndarray:
    """The indices of the features that hold for each line with a word, in order; each line has as many."""
    seen: set[bytes] = set()
    shares, lengths, repeated = [], [], []
    for line in lines:
        size = max(1, len(line))
        words = line.split()
        letters = size - len(line.translate(None, UPPER + LOWER))
        shares.append((
            (size - len(line.translate(None, SYMBOLS))) / size,
            line.count(b"!") / size,
            (size - len(line.translate(None, UPPER))) / max(1, letters),
            (size - len(line.translate(None, DIGITS))) / size,
            (line.count(b".") + line.count(b",")) / size,
            line.count(b"|") / size,
            1 - len(set(words)) / max(1, len(words)),
        ))
        lengths.append(len(words))
        repeated.append(line in seen)
        seen.add(line)
    binned = np.searchsorted(EDGES, np.array(shares).reshape(len(lines), N_SHARES), side="right")
    width = len(EDGES) + 1
    return np.column_stack([
        np.where(repeated, 1, 0),
        2 + binned + width * np.arange(N_SHARES),
        2 + N_SHARES * width + np.searchsorted(LENGTHS, lengths, side="right"),
    ]).astype(np.int64)


def viterbi(chain: LineChain, scores: np.ndarray) -> list[int]:
    """The best labels of one document's lines; of equally good ones, content."""
    (a00, a01), (a10, a11) = chain.pairs.tolist()
    best0, best1, back = 0.0, 0.0, []
    for i, s in enumerate(scores.tolist()):
        if i:
            from0, to1 = best1 + a10 > best0 + a00, best1 + a11 >= best0 + a01
            back.append((int(from0), int(to1)))
            best0, best1 = max(best0 + a00, best1 + a10), s + max(best0 + a01, best1 + a11)
        else:
            best1 = s
    labels = [1 if best1 >= best0 else 0]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def train(lines: list[np.ndarray], labels: list[int], rounds: int = 80, rate: float = 0.1, decay: float = 1e-3) -> LineChain:
    """Maximum likelihood by forward and backward sums; ``labels`` has one label for all lines of a document.

    Lines have no labels of their own, so a line takes that of its document.
    """
    if len(set(labels)) < 2:
        return LineChain.blank()
    longest = max(map(len, lines))
    n = len(lines)
    length = np.array([len(x) for x in lines])
    mask = np.arange(longest) < length[:, None]
    features = np.zeros((n, longest, lines[0].shape[1]), np.int64)
    features[mask] = np.concatenate(lines)
    truth = np.array(labels)
    params = np.zeros(N_FEATURES + 4)
    first, second = np.zeros_like(params), np.zeros_like(params)
    total = mask.sum()
    for step in range(1, rounds + 1):
        weights, pairs = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
        score = np.zeros((n, longest, 2))
        score[..., 1] = weights[features].sum(-1)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for i in range(1, longest):
            ahead[:, i] = score[:, i] + np.logaddexp.reduce(ahead[:, i - 1, :, None] + pairs, axis=1)
        behind = np.zeros((n, longest, 2))
        for i in range(longest - 2, -1, -1):
            at = np.logaddexp.reduce(pairs + (score[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
            behind[:, i] = np.where(mask[:, i + 1, None], at, 0)
        whole = np.logaddexp.reduce(ahead[np.arange(n), length - 1], axis=1)
        p1 = np.exp(ahead[..., 1] + behind[..., 1] - whole[:, None])
        error = np.where(mask, truth[:, None] - p1, 0)
        gradient = np.zeros_like(params)
        gradient[:N_FEATURES] = np.bincount(features.ravel(), np.repeat(error.ravel(), features.shape[2]), N_FEATURES)
        both = mask[:, 1:]
        joint = ahead[:, :-1, :, None] + pairs + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        wanted = np.zeros((2, 2))
        for y in (0, 1):
            wanted[y, y] = both[truth == y].sum()
        gradient[N_FEATURES:] = (wanted - np.exp(joint)[both].sum(0)).ravel()
        gradient = gradient / total - decay * params
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return LineChain(params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2))


def _lines(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.split()]


def fit_line_chain(docs: DataFrame, labels: DataFrame, sample: int = TRAINING_DOCUMENTS) -> LineChain:
    """The chain trained on at most ``sample`` labelled documents of either quality, taken in hash order of their ids.

    Null ids, labels and texts are left out; without documents of both qualities every line is content.
    """
    ids = []
    for quality in (0, 1):
        some = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        ids += [(r.doc_id, quality) for r in some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not ids:
        return LineChain.blank()
    known = dict(ids)
    # A broadcast of at most 2 * sample ids.
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in known], "doc_id long"))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").filter("text IS NOT NULL")
    begun = rows.groupBy("doc_id").agg(F.min(F.substring("text", 1, TRAINING_CHARS)).alias("text"))
    found = sorted((r.doc_id, r.text) for r in begun.collect())
    lines = [(_lines(text.encode())[:TRAINING_LINES], known[i]) for i, text in found]
    lines = [(x, y) for x, y in lines if x]
    return train([line_features(x) for x, _ in lines], [y for _, y in lines]) if lines else LineChain.blank()


def repeated_words(words: list[bytes]) -> int:
    """Words in five-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def judge(text: str | None, chain: LineChain) -> tuple:
    """One row of SCHEMA."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    word_chars = len(b"".join(words).decode())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = _lines(data)
    repeats = repeated_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    labels = viterbi(chain, chain.weights[line_features(lines)].sum(1)) if lines else []
    content = sum(len(line.split()) for line, y in zip(lines, labels) if y)
    share = content / n if n else 0.0
    return (
        n, word_chars, symbols, len(lines) - len(set(lines)), repeats, len(lines), sum(labels), share,
        failed, not failed and share >= CONTENT_SHARE,
    )


def quality_rules(docs: DataFrame, chain: LineChain, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (doc_id by default) and the counts, content share and verdict of each whole text.

    One row per row, repeated ids too. A null or empty text has no words and fails; a null id stays null; other
    columns of ``docs`` are not read, whatever their names. Ties between labels count as content.
    """
    keep = keep or ["doc_id"]
    # A text that is kept anyway is sent once.
    rows = docs.select(*keep, *(c for c in ["text"] if c not in keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep) + ", " + SCHEMA
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def each(batch: pa.RecordBatch) -> dict:
        # A worker that has encoded texts before gives back what it remembers of them.
        pieces.cache_clear()
        columns = zip(*(judge(t, chain) for t in batch.column("text").to_pylist()))
        return {name: batch.column(name) for name in keep} | {k: list(v) for k, v in zip(names, columns)}

    return map_batches(rows, each, schema, at_once=TEXTS_AT_ONCE)
