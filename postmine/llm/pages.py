"""The main text of web pages: the best contiguous region of a page read as words and tags.

Words score above zero and tags below, by weights that come from labelled pages; one scan finds the contiguous stretch
of the highest sum. The text of that stretch is cut into blocks at block-level tags.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmine.llm.rows import map_batches

#: Labelled pages that train the weights, taken in hash order of their ids. Extraction has no bound.
TRAINING_PAGES = 400
#: A page whose best region scores no more than this has no main text: less than one word in a place for text.
LEAST_SCORE = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|iframe|svg|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ROLE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements that never hold main text, and names of a class, id or role that say the same of any element.
ASIDE = frozenset("head title nav header footer aside form menu button select dialog".split())
ASIDE_ROLE = re.compile(
    r"(?:ad|ads|advert(?:s|isements?|ising)?|banners?|comments?|cookies?|footer|header|menu|nav|navbar|navigation|notice|popup|promo(?:s|tions?)?|related|share"
    r"|sidebar|social|sponsor(?:s|ed)?|subscribe|widget)",
    re.I,
)
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A new one of these ends an open one of the same kind.
UNCLOSED = frozenset("p li dt dd tr td th option".split())


@dataclass(eq=False)
class Element:
    """An open element; ``start`` and ``end`` count the words of the page before it and to its end, boilerplate left out."""

    name: str
    aside: Boilerplate | None
    start: int
    end: int | None = None


@dataclass(eq=False)
class Boilerplate:
    """An element of boilerplate: its parent, the words before it, and whether an article or main element is around it."""

    parent: Element | None
    words: int
    label: bool

    def enclosed(self) -> bool:
        """Whether content is around it: an article or main element, or words on both sides in its parent."""
        around = self.parent
        if self.label or around is None or around.name in ("html", "body"):
            return self.label
        return around.start < self.words and (around.end is None or around.end > self.words)


@dataclass
class Token:
    """A tag or a run of words: the kind of tag, or of the element around the words; a block break; the text."""

    kind: str
    words: int = 0
    text: str = ""
    breaks: bool = False
    aside: bool = False
    label: bool = False
    free: bool = False


@dataclass
class Weights:
    """By kind: what one word inside such an element scores, and what such a tag costs; free tokens do neither."""

    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)

    def score(self, token: Token) -> float:
        if token.free:
            return 0.0
        if token.words:
            return token.words * self.word.get(token.kind, 0.5)
        return -self.tag.get(token.kind, 0.001 if token.label else 1.0)


def says_aside(rest: str) -> bool:
    """Whether a class, id or role is boilerplate by its whole name, or by every part of it, as cookie-banner."""
    names = (name for m in ROLE.finditer(rest) for name in (m[1] or m[2] or m[3] or "").split())
    return any(all(ASIDE_ROLE.fullmatch(x) for x in re.split("[-_]+", name.strip("-_"))) for name in names)


def tokens(page: str) -> list[Token]:
    """Tags and runs of words in order; ``label`` is set inside an article or main element.

    White space, comments, scripts and the like say nothing of where they stand, and boilerplate inside content does not
    end it: all of these are free.
    """
    out: list[Token] = []
    within: list[tuple[Token, Boilerplate]] = []
    words = 0
    stack: list[Element] = []

    def close(at: int) -> None:
        for x in stack[at:]:
            x.end = words
        del stack[at:]

    for m in TOKEN.finditer(page):
        name = (m["tag"] or "").lower()
        aside = stack[-1].aside if stack else None
        label = any(x.name in ("article", "main") for x in stack)
        if name:
            if m["end"]:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
                if at is not None:
                    close(at)
            elif name not in VOID and not m["rest"].rstrip().endswith("/"):
                if name in UNCLOSED and any(x.name == name for x in stack[-3:]):
                    close(max(i for i, x in enumerate(stack) if x.name == name))
                off = name in ASIDE or (name not in ("html", "body", "article", "main") and says_aside(m["rest"]))
                if off and not aside:
                    aside = Boilerplate(stack[-1] if stack else None, words, label)
                stack.append(Element(name, aside, words))
            # Tags of boilerplate are a kind of their own, like its words.
            kind = f"aside {name}" if aside else name
            out.append(Token(kind, breaks=name not in INLINE or name == "br", aside=bool(aside), label=label and name not in ("article", "main")))
        elif m["text"]:
            text = html.unescape(m["text"])
            kind = next((x.name for x in reversed(stack) if x.name not in INLINE or x.name == "a"), "body")
            out.append(Token("aside" if aside else kind, len(text.split()), text, aside=bool(aside), label=label, free=not text.strip()))
            words += 0 if aside else out[-1].words
        else:
            raw = (m["raw"] or "comment").lower()
            out.append(Token(raw, breaks=raw not in ("comment",), aside=True, label=label and raw == "comment", free=True))
        if aside:
            within.append((out[-1], aside))
    close(0)
    for token, element in within:
        token.free = token.free or element.enclosed()
    return out


def fit(pages: list[str]) -> Weights:
    """Weights from pages whose article or main element is taken as the labelled main text.

    A word counts by how often words of its kind are in labelled text; a tag costs little where it stands in labelled
    text and up to as much as the words of a block of boilerplate elsewhere. Unlabelled pages give default weights.
    """
    inside: Counter = Counter()
    whole: Counter = Counter()
    longest = 1
    for page in pages:
        found = tokens(page)
        if not any(t.label for t in found):
            continue
        run = 0
        for t in found:
            if not t.free:
                key = ("word" if t.words else "tag", t.kind)
                whole[key] += max(1, t.words)
                inside[key] += max(1, t.words) if t.label and not t.aside else 0
            run = 0 if t.label else run + t.words
            longest = max(longest, run)
    weights = Weights()
    for key, n in whole.items():
        share = (inside[key] + 0.5) / (n + 1)
        if key[0] == "word":
            weights.word[key[1]] = max(0.001, share**2)
        else:
            weights.tag[key[1]] = 0.001 + longest * (1 - share) ** 2
    return weights


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """The contiguous stretch [a, b) of the highest sum, the first of equal ones."""
    best, total, start = (0, 0, 0.0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best[2]:
            best = (start, i + 1, total)
    return best


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region, white space as single spaces, joined by line feeds; empty if there is none."""
    found = tokens(page or "")
    a, b, score = best_region([weights.score(t) for t in found])
    if score <= LEAST_SCORE:
        return ""
    blocks = [[]]
    for t in found[a:b]:
        if t.breaks:
            blocks.append([])
        elif not t.aside:
            blocks[-1].append(t.text)
    return "\n".join(x for x in (" ".join("".join(parts).split()) for parts in blocks) if x)


def fit_pages(pages: DataFrame, sample: int = TRAINING_PAGES) -> Weights:
    """Weights from at most ``sample`` pages that mark their main text, in hash order of page_id."""
    marked = pages.filter(F.lower("html").rlike("<(article|main)[ >]") & F.col("page_id").isNotNull())
    ids = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    # A broadcast of at most ``sample`` ids; the pages themselves come to the driver once.
    found = marked.join(F.broadcast(ids), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    return fit([r.html for r in found.orderBy("page_id").collect()])


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text and n_chars of every page. A null page has no text; ids and urls pass as they are."""

    def each(batch: pa.RecordBatch) -> dict:
        text = [main_text(x, weights) for x in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text, "n_chars": [len(x) for x in text]}

    return map_batches(pages.select("page_id", "url", "html"), each, "page_id long, url string, text string, n_chars long")
