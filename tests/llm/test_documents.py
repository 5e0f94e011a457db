"""Operators over documents, against plain versions, on odd rows and on given tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postmine.llm import forced_bpe, jaccard, order_minhash, packing, quality, repair, repeats
from tests.llm import brute

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(params=["documents", "odd", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


def copies(spark, n=150):
    """Near copies around one text, some of which hang together only through others."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(80)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(80)] = rng.choice(words)
        rows.append((i, " ".join(own[: rng.randrange(60, 81)])))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_base_rules(spark, table):
    found = quality.quality_rules(table, quality.LineChain.blank()).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found]
    assert brute.ordered(got) == brute.ordered((d, *brute.base_rules(t)) for d, t in pairs(table))
    assert all(r.kept == (not r.base_failed) for r in found)


def test_line_chain_keeps_clean_documents(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    chain = quality.fit_line_chain(documents, labels)
    rows = quality.quality_rules(documents, chain).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert quality.fit_line_chain(documents, labels.limit(0)).pairs.sum() == 0


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(50):
        scores, chain = rng.normal(size=6), quality.LineChain(np.zeros(1), rng.normal(size=(2, 2)))
        best = quality.viterbi(chain, scores)

        def value(y):
            return sum(scores[i] * y[i] for i in range(6)) + sum(chain.pairs[y[i], y[i + 1]] for i in range(5))

        every = [[k >> i & 1 for i in range(6)] for k in range(64)]
        assert value(best) == pytest.approx(max(map(value, every)))


def test_packing(spark, table):
    rows = packing.pack_documents(table, BYTES).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    want = []
    for doc, text in pairs(table):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert brute.ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute.ordered(want)
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(used) <= 1.03 * (sum(r.length for r in rows) / 2048) + 1


def test_packing_plan_is_small_and_tight():
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 200_000).astype(int) + 1)
    sizes, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan_packing({int(s): int(c) for s, c in zip(sizes, counts)})
    assert sum(c for _, _, c, *_ in plan.rows) == 200_000
    assert plan.sequences <= 1.005 * lengths.sum() / 2048 + 1
    assert len(plan.rows) < 50_000


def test_components(spark, table):
    got = jaccard.similarity_components(table).collect()
    assert brute.ordered(got) == brute.components(pairs(table))


def test_components_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 8)
    df = copies(spark)
    assert brute.ordered(jaccard.similarity_components(df).collect()) == brute.components(pairs(df))


def near_texts(n, edits, shared=0):
    """Copies of one text of 200 words with ``edits`` words changed; ``shared`` of them change alike in groups of three."""
    rng = random.Random(n)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        text = list(base)
        for k in range(edits):
            text[rng.randrange(200)] = f"e{i // 3 if k < shared else i}-{k}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("edits, shared", [(7, 0), (6, 0), (5, 2), (4, 0)])
def test_components_about_the_threshold(spark, monkeypatch, edits, shared):
    monkeypatch.setattr(jaccard, "GROUP", 8)
    rows = near_texts(150, edits, shared) + [(1000 + i, t) for i, t in near_texts(40, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert brute.ordered(jaccard.similarity_components(df).collect()) == brute.components(rows)


def test_near_texts_ask_in_proportion(spark, monkeypatch):
    counts = {}
    settle = jaccard.settle

    def counting(df, name):
        out = settle(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "settle", counting)
    asked = []
    for n in (300, 1200):
        counts.clear()
        df = spark.createDataFrame(near_texts(n, 7), "doc_id long, text string")
        assert jaccard.similarity_components(df).count() == n
        asked.append(counts["candidates"])
    assert asked[1] < 8 * asked[0] and asked[1] < 20 * 1200


def test_repeats(spark, table):
    got = repeats.remove_repeats(table).collect()
    assert brute.ordered(got) == brute.without_repeats(pairs(table))


def test_repeats_in_pieces(spark, monkeypatch):
    rng = random.Random(1)
    base = "".join(rng.choice("abcé ") for _ in range(400))
    rows = [
        (i, base[rng.randrange(200) :][: rng.randrange(300)] + "".join(rng.choice("ab") for _ in range(rng.randrange(60))) + base[rng.randrange(300) :])
        for i in range(60)
    ]
    rows += [(70, "ab" * 400), (71, "ab" * 30), (72, "ab" * 500), (73, "x" * 5000), (74, "x" * 49), (75, "x" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(repeats, "SLAB", 200)
    found = repeats.remove_repeats(df, keep=["doc_id"], text=True)
    assert brute.ordered(found.drop("text").collect()) == brute.without_repeats(rows)
    assert all(isinstance(r.text, str) for r in found.collect())


def test_slabs_cut_long_texts_alike():
    text = bytes(random.Random(4).choices(b"abcdef ", k=5000))
    small, large = ([(a.row, a.at, a.first, a.last) for a in repeats.slabs([text], size)] for size in (300, 1 << 20))
    starts = [
        sorted((int(i), int(p)) for row, at, first, last in some for i, a, b in zip(at, first, last) for p in range(a, b + 1)) for some in (small, large)
    ]
    assert starts[0] == starts[1] and len(starts[0]) == 5000 - 49


def test_order_fingerprints(spark, table):
    rows = sorted(
        pairs(table), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True
    )
    found = order_minhash.order_fingerprints(table).collect()
    assert len(found) == len(rows)
    by_id = {}
    for d, t in rows:
        by_id.setdefault(d, set()).add(order_minhash.fingerprint(t).astype(">u2").tobytes().hex())
    assert all(r.fingerprint in by_id[r.doc_id] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    if len({d for d, _ in rows}) == len(rows):
        want = {}
        for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
            new = order_minhash.edited(t or "", after or "")
            a, b, c = (order_minhash.fingerprint(x) for x in (t, new, after))
            want[d] = (len(t or ""), order_minhash.likeness(a, b), order_minhash.likeness(a, c))
        assert {r.doc_id: (r.n_chars, r.near_edited, r.near_next) for r in found} == want


def test_fingerprint_follows_order():
    words = [f"word{i}" for i in range(300)]
    text, moved = " ".join(words), " ".join(words[150:] + words[:150])
    a, b, c = (order_minhash.fingerprint(x) for x in (text, moved, text + " end"))
    assert order_minhash.likeness(a, c) > 0.9 > order_minhash.likeness(a, b)
    assert order_minhash.likeness(a, a) == 1.0


def test_token_shards(spark, table):
    shards = repair.write_shards(repair.token_rows(table, WORDS, 1), 49408, shard_ids=2000)
    got = repair.read_shards(shards).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t in pairs(table)]
    assert brute.ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == brute.ordered((d, len(x), zlib.crc32(x.tobytes())) for d, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_random_access():
    rng = np.random.default_rng(5)
    documents = [rng.choice([5, 6, 7, 8, 9], size=n, p=[0.6, 0.1, 0.1, 0.1, 0.1]) for n in rng.integers(1, 400, 60)]
    shard = repair.Shard.from_bytes(repair.Shard.of(list(range(60)), documents, 10).to_bytes())
    whole = np.concatenate(documents)
    assert len(shard.rules) and len(shard.sequence) < len(whole)
    assert all((shard.document(k) == x).all() for k, x in enumerate(documents))
    for a, b in rng.integers(0, len(whole), (100, 2)):
        assert (shard.ids(min(a, b), max(a, b)) == whole[min(a, b) : max(a, b)]).all()


def test_grammar_takes_every_repeat():
    rng = np.random.default_rng(6)
    passage, rare = rng.integers(0, 5000, 200), rng.integers(5000, 9000, 30)
    parts = [np.append(passage, rng.integers(9000, 40000, 5)) for _ in range(4000)]
    parts[::200] = [np.append(x, rare) for x in parts[::200]]
    ids = np.concatenate(parts)
    shard = repair.Shard.of([1], [ids], 49408)
    assert (shard.document(0) == ids).all() and shard.lengths.max() >= 200
    pair = (shard.sequence[:-1] << 32) | shard.sequence[1:]
    assert np.unique(pair, return_counts=True)[1].max() < repair.LEAST_COUNT
    assert len(shard.sequence) < 7 * len(parts)


def test_forced_bpe(spark, table):
    import hashlib

    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for d, t in pairs(table):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert brute.ordered(forced_bpe.encode_and_decode(table, WORDS).collect()) == brute.ordered(want)


def test_tokens_of_odd_strings():
    from postmine.llm.pieces import byte_level_ids, word_ids

    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'LL", "1", "é", "\x1c", "\t", ".", "!", "<|endoftext|>", "\xa0", " ", "漢", "Σ", "İ", "́", "\r\n",
             "<|startoftext|>", "ß", "ﬁ", "½", "😀", "\x00", "qx", "...", "$$$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(1500)]
    for path, encode in ((BYTES, lambda x: byte_level_ids(BYTES, x)), (WORDS, lambda x: word_ids(WORDS, x)), (WORDS, lambda x: map(forced_bpe.forced_bpe(WORDS).encode, x))):
        want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert list(encode(texts)) == want
