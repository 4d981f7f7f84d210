import random

import numpy as np
import pytest

from tessera.llm import leakage
from tessera.llm.leakage import aligned_chars, common_run, leaked_passages, qgram_hashes
from tessera.llm.unify import canonical_words

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in ("ara", "eno", "ilu") for c in ("", "s", "ti")]


def _corpus(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(13, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        words = [r.choice(WORDS) for _ in range(r.randint(0, 80))]
        if d % 2:
            src = r.choice(items)[1].split(" ")
            n = r.randint(9, len(src))
            at = r.randint(0, len(src) - n)
            piece = src[at : at + n]
            cut = r.randint(0, len(words))
            words = words[:cut] + [w.upper() if r.random() < 0.2 else w for w in piece] + words[cut:]
        docs.append((d, r.choice([" ", ", ", "\n", "-"]).join(words)))
    return docs, items


def _brute(docs, items):
    out = set()
    for d, t in docs:
        for i, x in items:
            if t and common_run(canonical_words(t).split(" "), canonical_words(x).split(" "), 13):
                out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_exact_pairs_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(leakage, "BROADCAST_QGRAMS", limit)  # 0: the join in place of the broadcast
    monkeypatch.setattr(leakage, "BITMAP_BITS", 1 << 16)
    docs, items = _corpus(7)
    got = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.where("exact").collect()} == _brute(docs, items)


def test_an_edit_is_found_but_not_exact(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    docs = [(1, "see " + item.replace("eta theta", "eta thetas") + " end"), (2, "nothing here"), (3, item)]
    got = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.exact) for r in got.collect()) == [(1, 5, False), (3, 5, True)]


def test_nulls_empty_short_and_repeats(spark):
    item = " ".join(WORDS[:14])
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, item, "a"), (3, item, "a"), (3, item, "b"), (4, "x" * 300000, "a")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, item, 0), (1, item, 1), (None, item, 0), (2, None, 0), (3, "too short", 0)], "item_id long, text string, h long")
    assert [(r.doc_id, r.item_id) for r in leaked_passages(docs, items).collect()] == [(3, 1)]
    assert leaked_passages(docs.limit(0), items).count() == 0 == leaked_passages(docs, items.limit(0)).count()


def test_hashes_and_alignment():
    assert len(qgram_hashes("abc", 4)) == 0 and len(set(qgram_hashes("abababab", 2))) == 2
    a, b = qgram_hashes("xxhello worldyy", 5), qgram_hashes("hello world", 5)
    assert np.array_equal(a[2:9], b)
    doc, item = "12345abcdefghij67890", "abcdefghij"
    assert aligned_chars(doc, item, 3, 7, 0, 8) == 10 and aligned_chars(doc, item, -4, 0, 0, 8) == 0
    assert aligned_chars("abcdeXfghij", item, -1, 2, 1, 8) == 10 and aligned_chars("abcdXfghij", item, -1, 2, 1, 8) == 9
    assert aligned_chars("abcdfghij", item, -2, 2, 1, 8) == 9 and aligned_chars("abXdeYghij", item, -1, 2, 1, 9) == 0


def test_both_ways_give_the_same_rows(spark, rows, monkeypatch):
    """Scores and edits too, with one text in a third of all documents."""
    docs, items = _corpus(3)
    r = random.Random(1)
    docs += [(1000 + i, items[0][1]) for i in range(30)] + [(2000 + i, " ".join(r.choice(WORDS) if r.random() < 0.06 else w for w in items[i % 12][1].split(" "))) for i in range(24)]
    docs += [(3000, "ba " * 4000), (3001, items[1][1] + " ba" * 500)]
    items += [(50, " ".join(["ba"] * 30)), (51, items[2][1] + " " + items[3][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    direct = rows(leaked_passages(d, i))
    monkeypatch.setattr(leakage, "BROADCAST_QGRAMS", 0)
    assert direct == rows(leaked_passages(d, i)) and len(direct) > 80
    assert {(a, b) for a, b, _, exact in direct if exact} == _brute(docs, items)


def test_entries_in_parts(monkeypatch):
    p = leakage.Passages(13, 40, 1)
    texts = [" ".join(["ba"] * 30), " ".join(WORDS[:20])]
    index = leakage.ItemIndex(texts, [38, 60], p)
    docs = ["ba " * 500, " ".join(WORDS[5:30]), " ".join(["ba"] * 40 + WORDS[:20])]
    whole = [index.bands(d) for d in docs]
    monkeypatch.setattr(leakage, "_ENTRIES", 50)
    assert whole == [index.bands(d) for d in docs] and all(whole)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_ids_of_any_type(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(leakage, "BROADCAST_QGRAMS", limit)
    monkeypatch.setattr(leakage, "BITMAP_BITS", 1 << 16)
    item = " ".join(WORDS[:14])
    docs = spark.createDataFrame([("d/1", item), ("d/2", "none"), (None, item)], "doc_id string, text string")
    assert rows(leaked_passages(docs, spark.createDataFrame([("i-1", item)], "item_id string, text string")), "doc_id", "item_id") == [("d/1", "i-1")]
