"""Filter audit, conversation tries and benchmark passages, against plain versions and their SQL."""

import random
import re

import numpy as np
import pytest

from postmine.llm import decontaminate, filter_audit, prefix_trie
from postmine.llm.oracle import ORACLE
from postmine.llm.queries import QUERIES
from tests.compare import connect, difference, plan
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) is None


LONG = " ".join(f"w{i}" for i in range(250))
AUDITED = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (None, LONG, "a"), (None, LONG, None), (3, LONG + " A" * 90, "a"),
    (4, LONG + " # B", None), (5, None, ""), (6, "", "b"), (7, "é " * 300, "b"), (8, "é\u00a0x\x0bY " * 200, "a"), (9, "A&B " * 10, "a"), (0, "", "c"), (4, "x" * 9000, "c"),
]
FLAGS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (None, 1, 1), (9, 0, 0), (77, 1, 1), (6, 1, 1), (6, 1, 1)]


def test_filter_audit_equals_every_order_run_in_turn(spark):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in AUDITED], "doc_id long, text string, source string, mask int, digest string").repartition(3)
    labels = spark.createDataFrame([(*r, "clash") for r in FLAGS], "doc_id long, quality int, toxic int, text string")
    found = filter_audit.audit_filters(docs, labels)
    assert brute.ordered(found.collect()) == brute.filter_audit(AUDITED, FLAGS)
    assert [f.name for f in found.schema] == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_filters(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_a_third_of_all_rows_may_be_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, repeat('same words ', 300), concat('text ', id)) AS text", "IF(id % 2 = 0, 'hot', concat('s', id % 50)) AS source")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "CAST(doc_id % 5 = 0 AS INT) AS toxic")
    assert brute.ordered(filter_audit.audit_filters(docs, labels).collect()) == brute.filter_audit(rows, [tuple(r) for r in labels.collect()])


def test_removal_ranks_are_a_min_plus_product():
    rng = np.random.default_rng(1)
    masks = np.where(rng.random((8, 4)) < 0.5, 0, filter_audit.NEVER)
    positions = np.array([rng.permutation(4) for _ in range(6)])
    got = filter_audit.removal_ranks(masks, positions)
    want = [[min([int(p) for p, m in zip(q, row) if m == 0], default=filter_audit.NEVER) for q in positions] for row in masks]
    assert got.tolist() == want


def talk(conv, n, topic=0, start=1):
    return [(conv, start + i, "user" if i % 2 else None, f"turn {i} of {topic}\x0bwords" if i % 5 else None) for i in range(n)]


TALKS = [
    *talk(0, 4), *talk(1, 6), *talk(2, 6), *talk(3, 1), *talk(7, 2, 9), *talk(9, 1), *talk(20, 2, 1), *talk(21, 3, 1), *talk(22, 5, 1), *talk(23, 4, 1),
    *talk(45, 1, 2), *talk(46, 1, 2), *talk(48, 3, 2), *talk(-3, 5, 3), *talk(-20, 3, 4), *talk(-33, 6, 5), *talk(60, 90, 6), *talk(61, 90, 6), *talk(62, 70, 6),
    *talk(None, 5), (7, None, "system", "first of all"), (7, 2, "b", "tie"), (7, 2, "a", "tie"), (7, 2, "a", "tie"), (80, None, None, None),
]


@pytest.mark.parametrize("at_once", [10_000, 7])
def test_trie_equals_a_plain_one(spark, at_once):
    schema = "conv_id long, turn int, role string, text string, depth long, digest string"
    rows = spark.createDataFrame([(*r, 3, "clash") for r in TALKS], schema).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
    try:
        found = prefix_trie.prefix_trie(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert brute.ordered(found) == brute.prefix_trie(TALKS)
    assert prefix_trie.prefix_trie(rows.limit(0)).count() == 0


def test_a_third_of_all_conversations_share_their_turns(spark):
    rng = random.Random(3)
    rows = [r for c in range(400) for r in (talk(c, 12, 1) if c % 3 == 0 else talk(c, rng.randint(1, 9), rng.randint(2, 9)))]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert brute.ordered(found.collect()) == brute.prefix_trie(rows)


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


ITEMS = [
    (1, words(0, 30)), (2, words(100, 110)), (3, words(200, 207)), (4, "Stop. the"), (10, "solitary"), (11, words(0, 12)), (11, words(300, 315)),
    (12, None), (13, ""), (14, " .!? "), (None, words(400, 415)), (None, words(100, 112)), (15, "É A é b Ç d " + words(0, 8)), (15, words(100, 110)),
    (16, "same " * 25), (17, words(500, 505)), (18, words(600, 604)), (19, words(0, 10) + " tail"),
]
PASSAGES = [
    (1, words(0, 9)), (2, words(0, 10)), (3, "x " + words(5, 25).upper() + " y"), (4, words(0, 14) + " x " + words(14, 24)), (5, "stop - THE; solitary Solitary"),
    (6, words(200, 207) + " " + words(199, 206)), (7, words(300, 315).replace(" ", "\x00\n")), (8, words(400, 411)), (9, words(100, 115)), (9, words(100, 115)), (9, "other"),
    (None, words(100, 115)), (None, None), (10, None), (11, ""), (12, "É A é B Ç d " + words(0, 8)), (13, "é a é b ç d " + words(0, 8)), (14, "same " * 40), (15, "same " * 9),
    (16, words(499, 506) + " " + words(601, 604) + " " + words(600, 604)), (17, words(0, 30) * 3), (18, "漢字 " * 5000 + words(0, 11)), (19, "one"), (20, words(0, 10) + " tail"),
]


@pytest.mark.parametrize("way", ["plain", "copies", "full bits"])
def test_contamination_equals_a_plain_search(spark, monkeypatch, way):
    if way == "copies":
        monkeypatch.setattr(decontaminate, "fits", lambda rows, size: False)
    if way == "full bits":
        monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
        monkeypatch.setattr(decontaminate, "LEAST_BITS", 64)
    clash = "row string, words int, found int, length string, first string"
    docs = spark.createDataFrame([(*r, "a", 1, 2, "b", "c") for r in PASSAGES], f"doc_id long, text string, {clash}").repartition(3)
    items = spark.createDataFrame([(*r, "a", 1, 2, "b", "c") for r in ITEMS], f"item_id long, text string, {clash}")
    found = decontaminate.find_contamination(docs, items)
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan(found))
    assert brute.ordered(found.collect()) == brute.contamination(PASSAGES, ITEMS)


def test_contamination_of_and_by_nothing(spark):
    docs = spark.createDataFrame(PASSAGES, "doc_id long, text string")
    for items in ([], [(1, None), (2, " . ")]):
        found = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
        assert brute.ordered(found.collect()) == brute.contamination(PASSAGES, items)
    assert decontaminate.find_contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_a_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(5)
    docs = [(i, (words(0, 20) if i % 3 == 0 else "") + " ".join(rng.choices(["a", "b", "w7", "w8"], k=60))) for i in range(900)]
    items = [(i, words(0, 12) + f" of item {i} " + " ".join(rng.choices(["a", "b"], k=12))) for i in range(40)]
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert brute.ordered(found.collect()) == brute.contamination(docs, items)
