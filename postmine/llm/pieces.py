"""Token ids of whole texts, looked up piece by piece.

A text is cut where the tokenizer is sure to cut as well; the ids of a piece come from the tokenizers library
and are remembered, because the same words come again and again. Texts are cut and put together by compiled code, many at
a time: pieces that differ are cut into word and punctuation, and only words that are not remembered are looked up one by one.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: A remembered piece or word is at most so long, and so many are remembered per worker; longer ones are encoded each time.
PIECE_CHARS = 32
PIECES = 1_000_000
#: Arrow goes through all remembered words each time: not worth it for less than one in so many.
FEW = 32
#: About so many bytes of text are cut at a time.
AT_ONCE = 1 << 23

#: Before a single space between two other characters a byte-level pre-tokenizer always cuts: the space goes with
#: what follows. ``\s`` here takes in all that the tokenizer counts as white space.
BYTE_LEVEL_CUT = re.compile(r"(?<=\S) (?=\S)")

#: A text without these, and without white space at its ends, can be cut at each space.
UNUSUAL = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def is_plain(text: str) -> bool:
    """Whether a text that is not empty can be cut at each space."""
    return not ("  " in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or UNUSUAL.search(text))


def byte_level_cut(text: str) -> list[str]:
    return text.split(" ") if is_plain(text) else BYTE_LEVEL_CUT.split(text)


#: Letters that every normal form leaves alone, then signs that are neither letters, digits nor apostrophes.
LETTERS, SIGNS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+", "[!-&(-/:;=?-@\\[-`{-~]{0,8}"
SIMPLE = re.compile(f"({LETTERS})({SIGNS})")
#: The same for Arrow, which wants names.
WORD_AND_TAIL = f"^(?P<word>{LETTERS})(?P<tail>{SIGNS})$"


def _byte_level() -> dict[int, str]:
    """What the byte-level alphabet writes for a space and for Latin letters beyond ASCII."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in sign:
            sign[b] = chr(256 + len(sign) - len(shown))
    return {32: sign[32], **{c: "".join(sign[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}}


BYTE_LEVEL = _byte_level()


class Pieces(dict):
    """Ids as little-endian unsigned 32-bit integers, by piece; missing ones are encoded.

    Words that ``of_all`` meets are remembered apart in two Arrow arrays, which take a fraction of the memory of Python's strings;
    at least three of four places are theirs.
    """

    def __init__(self, path: str, prefix: str = ""):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.prefix = prefix
        self.tails: dict[str, bytes] = {}
        self.words, self.word_ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.space = BYTE_LEVEL[32] if prefix else ""
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.tokenize = self.tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        """Most pieces are a word and punctuation: two words for the model, without the library's splitting."""
        found = (piece, "") if piece.isascii() and piece.isalpha() else (m := SIMPLE.fullmatch(piece)) and m.groups()
        if found:
            word, tail = found
            ids = self._word(word.lower() if self.lower else word)
            if tail:
                ids += self._tail(tail)
        else:
            ids = array("I", self.tokenizer.encode(self.prefix + piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES // 4:
                self.clear()
            self[piece] = ids
        return ids

    def of_all(self, different: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of pieces that all differ. Only words not met before and pieces of another kind are handled one by one."""
        if len(different) * FEW < len(self.words):
            return pa.array([self[piece] for piece in different.to_pylist()], pa.large_binary())
        cut = pc.extract_regex(different, WORD_AND_TAIL)
        simple = pc.and_(cut.is_valid(), pc.less_equal(pc.utf8_length(different), PIECE_CHARS))
        words, tails = (pc.struct_field(cut, name).filter(simple) for name in ("word", "tail"))
        words, tails = (pc.utf8_lower(words) if self.lower else words).dictionary_encode(), tails.dictionary_encode()
        ends = pa.array([self._tail(x) if x else b"" for x in tails.dictionary.to_pylist()], pa.large_binary())
        ids = pc.binary_join_element_wise(
            self._words(words.dictionary).take(words.indices), ends.take(tails.indices), pa.scalar(b"", pa.large_binary())
        )
        other = [self[piece] for piece in different.filter(pc.invert(simple)).to_pylist()]
        if not other:
            return ids
        # Row by row from one of the two.
        simple = np.asarray(simple)
        at = np.where(simple, np.cumsum(simple) - 1, len(ids) + np.cumsum(~simple) - 1)
        return pa.concat_arrays([ids, pa.array(other, pa.large_binary())]).take(pa.array(at))

    def _words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of words that all differ; from now on they are remembered."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        if len(new):
            ids = pa.concat_arrays([self.word_ids, pa.array([self._word(x) for x in new.to_pylist()], pa.large_binary())])
            at = np.asarray(at.fill_null(-1)).copy()
            at[at < 0] = np.arange(len(self.words), len(ids))
            found = ids.take(pa.array(at))
            if len(ids) > (most := PIECES - PIECES // 4):
                self.words, self.word_ids = words[:most], found[:most]
            else:
                self.words, self.word_ids = pa.concat_arrays([self.words, new]), ids
            return found
        return self.word_ids.take(at)

    def _word(self, word: str) -> bytes:
        return self._ids(self.space + (word if word.isascii() else word.translate(BYTE_LEVEL)))

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = self._ids(tail)
        return self.tails[tail]

    def _ids(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()


@lru_cache(maxsize=4)
def pieces(path: str, prefix: str = "") -> Pieces:
    """One per worker process and file."""
    return Pieces(path, prefix)


def _slices(texts: pa.Array | Iterable[str | None]) -> Iterator[pa.Array]:
    """The texts, null ones empty, in slices of about AT_ONCE bytes; a longer text is a slice of its own."""
    if not isinstance(texts, pa.Array):
        texts = pa.array(list(texts), pa.string())
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
        yield texts.slice(at, end - at)
        at = end


def _looked_up(known: Pieces, cut: pa.ListArray, skip: int = 0) -> Iterator[bytes]:
    """The ids of each list of pieces, without those of the first ``skip`` pieces."""
    found = cut.flatten().dictionary_encode()
    # Wide offsets: a single text can have more ids than four bytes can count.
    ids = known.of_all(found.dictionary).take(found.indices)
    _, edges, data = ids.buffers()
    edges = np.frombuffer(edges, np.int64, len(ids) + 1, 8 * ids.offset)
    offsets = np.asarray(cut.offsets).astype(np.int64)
    offsets -= offsets[0]
    for a, b in zip(edges[offsets[:-1] + skip].tolist(), edges[offsets[1:]].tolist()):
        yield data[a:b].to_pybytes() if b > a else b""


def byte_level_ids(path: str, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
    """Ids of whole texts for a byte-level tokenizer without added space; null counts as empty."""
    first, rest = pieces(path), pieces(path, " ")
    for part in _slices(texts):
        strings = part.to_pylist()
        plain = [bool(text) and is_plain(text) for text in strings]
        cut = pc.split_pattern(part.filter(pa.array(plain, pa.bool_())), " ")
        begins = cut.flatten().take(pa.array(np.asarray(cut.offsets)[:-1] - np.asarray(cut.offsets)[0])).to_pylist()
        ready = zip(begins, _looked_up(rest, cut, skip=1)) if len(cut) else iter(())
        for text, simple in zip(strings, plain):
            if simple:
                begin, ids = next(ready)
                yield first[begin] + ids
            elif text:
                begin, *more = BYTE_LEVEL_CUT.split(text)
                yield first[begin] + b"".join(map(rest.__getitem__, more))
            else:
                yield b""


def word_ids(path: str, texts: pa.Array | Iterable[str | None]) -> Iterator[bytes]:
    """Ids of whole texts for a tokenizer that drops white space; null counts as empty.

    A text is cut at white space of ASCII, which the tokenizer drops; other white space stays within its piece.
    """
    known = pieces(path)
    for part in _slices(texts):
        yield from _looked_up(known, pc.ascii_split_whitespace(part))
