"""Byte-pair encoding with forced cuts, and decoding.

A merge only ever makes a vocabulary token, so two bytes that stand next to each other inside no token are never
merged: between them every encoding has a cut. White space stands inside no token at all and cuts a text into words;
the rare pairs of bytes cut the words into fragments. Fragments are encoded on their own and remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from postmine.llm.rows import map_batches

#: What one worker remembers at most; longer words are encoded each time.
WORDS, WORD_CHARS = 800_000, 32

#: How the vocabulary writes bytes and word ends, and how the tokenizer splits words.
WORD_END = "</w>"
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Splitting at these differs between Python and the tokenizer, for which they are no white space.
NO_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_signs() -> list[str]:
    """The sign of each byte in a byte-level vocabulary: itself where it shows, else the next one above 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ForcedBpe(dict):
    """Ids of words, as little-endian unsigned 32-bit integers; missing ones are encoded."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.signs = byte_signs()
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Pairs of signs that stand inside some token; between all others a cut is forced.
        self.inside = {pair for t in self.vocab for s in (t.removesuffix(WORD_END),) for pair in zip(s, s[1:])}
        self.fragments: dict[tuple[str, bool], bytes] = {}

    def cuts(self, signs: str) -> list[str]:
        """The fragments of a pre-token between forced cuts."""
        at = [0, *(i for i in range(1, len(signs)) if (signs[i - 1], signs[i]) not in self.inside), len(signs)]
        return [signs[a:b] for a, b in zip(at, at[1:])]

    def _merge(self, fragment: str, ends: bool) -> bytes:
        """Merges by rank, the leftmost of equal ones first."""
        parts = list(fragment)
        if ends:
            parts[-1] += WORD_END
        while len(parts) > 1:
            rank, pair = min((self.ranks.get(p, 1 << 60), p) for p in zip(parts, parts[1:]))
            if rank == 1 << 60:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return array("I", [self.vocab[p] for p in parts if p in self.vocab]).tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = word if word.isascii() else unicodedata.normalize("NFC", word)
        # Letters are put in lower case one by one: no letter has a form of its own at the end of a word.
        plain = plain.replace("Σ", "σ").lower()
        out = []
        for token in PRETOKENS.findall(plain):
            fragments = self.cuts("".join(self.signs[b] for b in token.encode()))
            for i, fragment in enumerate(fragments):
                key = (fragment, i == len(fragments) - 1)
                if key not in self.fragments:
                    if len(self.fragments) > WORDS:
                        self.fragments.clear()
                    self.fragments[key] = self._merge(*key)
                out.append(self.fragments[key])
        ids = b"".join(out)
        if len(word) <= WORD_CHARS:
            if len(self) > WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        out = []
        for i, part in enumerate(self.split_special.split(text or "") if self.split_special else [text or ""]):
            if i % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                words = [w for w in SPACE.split(part) if w] if NO_SPACE.search(part) else part.split()
                out += map(self.__getitem__, words)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens as the vocabulary writes them, with spaces between: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def forced_bpe(path: str) -> ForcedBpe:
    return ForcedBpe(path)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded text, and n_tokens and SHA-256 of both, of every whole text.

    A null or empty text has no ids. One row per row; a null id stays null; other columns are not read.
    """

    def each(batch: pa.RecordBatch) -> dict:
        bpe = forced_bpe(path)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256")}
        for text in batch.column("text").to_pylist():
            ids = bpe.encode(text)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return {"doc_id": batch.column("doc_id"), **out}

    return map_batches(docs.select("doc_id", "text"), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
