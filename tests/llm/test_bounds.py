"""What operators look up, ask about and hold, beyond their rows."""

import random
import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from postmine.llm import jaccard, pieces, repeats, rows

from . import brute


def test_a_shared_passage_is_no_candidate(spark, monkeypatch):
    """Texts that share a rare passage, but not nearly enough for a link, are left alone."""
    counts = {}
    settle = jaccard.settle

    def counting(df, name):
        out = settle(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "settle", counting)
    rng = random.Random(3)
    rows = []
    for i in range(240):
        words = [str(rng.random()) for _ in range(60)]
        words[20:34] = [f"passage-{i // 2}-{k}" for k in range(14)]
        rows.append((i, " ".join(words)))
    # Links just above the threshold still come out: 60 shingles, of which 5 differ.
    rows += [(1000 + i, f"{t} new{i}" if i % 2 else t.replace(t.split()[-1], "other")) for i, t in rows[:40]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert brute.ordered(jaccard.similarity_components(df).collect()) == brute.components(rows)
    print("asked", counts["asked"])
    assert counts["asked"] <= 40


@pytest.mark.parametrize("low, high", [(5, 5), (3, 9), (10, 14), (1, 40)])
def test_no_link_is_ruled_out(spark, low, high):
    """Of all sizes and common tokens that link, none fails the test on first tokens."""
    rows = []
    for n in range(1, 41):
        for m in range(low, high + 1):
            for common in range(1, min(n, m) + 1):
                if 5 * common < 4 * (n + m - common):
                    continue
                ends = [x - int(jaccard.least_common(x)) + 1 for x in (n, m)]
                # At worst all common tokens but those behind the first ones of the set that ends earlier.
                shared = max(common - (max(n, m) - max(e for e, x in zip(ends, (n, m)) if x == max(n, m))), 0)
                rows.append((n, low, high, shared))
    if not rows:
        pytest.skip("no such sizes")
    df = spark.createDataFrame(rows, "n long, low long, high long, shared long")
    assert df.filter(~jaccard._may_link(*(df[c] for c in ("n", "low", "high", "shared")))).count() == 0


def test_strings_of_a_range_take_little_memory():
    rng = np.random.default_rng(5)
    shared = bytes(rng.integers(97, 123, 3000, dtype=np.uint8)).decode()
    texts = [bytes(rng.integers(97, 123, 9000, dtype=np.uint8)).decode() + shared for _ in range(400)]
    marks = [a.at[a.row == r] for a in repeats.slabs([t.encode() for t in texts], 1 << 30) for r in range(len(texts))]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": list(range(len(texts))), "text": texts, "text_hash": [0] * len(texts), "said": [x.astype("<u4").tobytes() for x in marks],
    })
    found = pa.Table.from_batches(list(repeats._string_blocks(1)(iter([batch]))))
    found = found.set_column(3, "payload", found.column("payload").cast(pa.binary()))
    data = sum(len(repeats._read_strings(p)[4]) for d, p in zip(found.column("doc_id").to_pylist(), found.column("payload").to_pylist()) if d is None)
    tracemalloc.start()
    repeats._compare_strings(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("bytes a byte of strings", peak / data)
    assert peak < 18 * data


@pytest.mark.parametrize("encode, file", [(pieces.word_ids, "word_bpe_49k.json"), (pieces.byte_level_ids, "byte_bpe_50k.json")])
def test_equal_pieces_are_looked_up_once(monkeypatch, encode, file):
    asked = []

    class Counting(pieces.Pieces):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece) if piece in self else self.__missing__(piece)

    path = public_tokenizers.path(file)
    known = {}
    monkeypatch.setattr(pieces, "pieces", lambda path, prefix="": known.setdefault(prefix, Counting(path, prefix)))
    texts = ["Many words, which come again and again."] * 500 + [None, "", " a  b c ", "　d\x1ce f\n"]
    got = list(encode(path, texts))
    plain = pieces.Pieces(path).tokenizer
    assert got == [np.array(plain.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    # First words, which have no space before them, are asked for by text.
    assert len(asked) < 600


def test_remembered_words_take_little_memory():
    known = pieces.Pieces(public_tokenizers.path("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrst"
    words = pa.array([a + b + c + "lyness" + d for a in letters for b in letters for c in letters for d in letters[:5]])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    want = known.of_all(words).to_pylist()
    held = tracemalloc.get_traced_memory()[0] - sum(map(sys.getsizeof, want)) + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    print("bytes a word", held / len(words))
    assert held < 100 * len(words)
    # Punctuation and capitals make no new words; nothing is asked of the tokenizer again.
    known.tokenize = None
    known.tails["."] = b"...."
    assert known.of_all(pa.array([w.title() + "." for w in words.to_pylist()])).to_pylist() == [x + b"...." for x in want]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "PIECES", 40)
    path = public_tokenizers.path("byte_bpe_50k.json")
    known = pieces.Pieces(path, " ")
    words = [a + b + tail for a in "abcdefgh" for b in "ijklmnop" for tail in ("", "é,", "1")] + ["x" * 50, "漢"]
    for at in range(0, len(words), 25):
        part = words[at : at + 25]
        assert known.of_all(pa.array(part)).to_pylist() == [np.array(known.tokenizer.encode(" " + w, add_special_tokens=False).ids, "<u4").tobytes() for w in part]
        assert len(known) <= 10 and len(known.words) == len(known.word_ids) <= 30


def test_workers_give_memory_back():
    # Small blocks under one that stays: the C library keeps them.
    parts = [b"x" * (100_000 + i) for i in range(1000)]
    last = parts.pop()
    del parts

    def resident() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    before = resident()
    rows.give_back()
    print("MB given back", (before - resident()) >> 20)
    assert resident() < before - (32 << 20) and last
