import random
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.packing import TOKENIZER, first_fit_decreasing, pack, pack_documents, token_counter


def _plain(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        for b, room in enumerate(bins):
            if room >= sizes[i]:
                break
        else:
            b = len(bins)
            bins.append(capacity)
        bins[b] -= sizes[i]
        out[i] = b
    return out


def test_tree_equals_plain_first_fit():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 17, 64, 65):
        sizes = [r.choice([0, 1, 5, 10, 33, 50, 51, 99, 100]) for _ in range(n)]
        assert first_fit_decreasing(sizes, 100) == _plain(sizes, 100)


def _check(got, want, capacity):
    load, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.container] += r.size
        pieces[r.item_id].append((r.piece, r.size))
    assert all(v <= capacity for v in load.values())
    for i, w in want.items():
        mine = sorted(pieces[i])
        assert [p for p, _ in mine] == list(range(len(mine))) and sum(s for _, s in mine) == w
        assert len(mine) == max(1, -(-w // capacity))
    return len(load)


def test_every_item_is_placed_once(spark):
    r = random.Random(2)
    want = {i: r.choice([0, 1, 7, 400, 900, 1000, 2048, 2049, 5000]) for i in range(500)}
    df = spark.createDataFrame([(i, s, "x") for i, s in want.items()], "item long, size long, container string")
    n = _check(pack(df, item_id="item", size="size", capacity=2048, group_items=100).collect(), want, 2048)
    assert n <= 1.15 * sum(want.values()) / 2048 + 6


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, 5), (2, 5), (2, 5)], "item long, size long")
    got = pack(df, item_id="item", size="size", capacity=10).collect()
    assert sorted((r.item_id or 0, r.size) for r in got) == [(0, 5), (2, 5), (2, 5)]
    assert pack(df.limit(0), item_id="item", size="size", capacity=10).count() == 0


def test_tokens_and_documents(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "word " * 9000), (5, "<|endoftext|>")], "doc_id long, text string")
    counts = {r.doc_id: r.n for r in df.select("doc_id", token_counter(TOKENIZER)(F.col("text")).alias("n")).collect()}
    assert counts[1] == 2 and counts[2] == 0 and counts[3] is None and counts[4] >= 9000 and counts[5] > 1
    got = pack_documents(df).collect()
    assert {r.doc_id for r in got} == {1, 2, 4, 5} and sum(r.n_tokens for r in got if r.doc_id == 4) == counts[4]


def test_copies_of_one_row_go_to_many_groups(spark):
    """A third of all rows are one row; rows numbered where they are scanned tell copies apart."""
    df = spark.range(3000, numPartitions=4).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS item", "5L AS size", "monotonically_increasing_id() AS n")
    got = pack(df, item_id="item", size="size", capacity=50, row="n", group_items=100)
    groups = got.selectExpr("item_id", "shiftright(container, 32) AS g").groupBy("g").count().collect()
    assert sum(r["count"] for r in groups) == 3000 and max(r["count"] for r in groups) < 160
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pack(df, item_id="item", size="size", capacity=50, row="n", group_items=100).collect()))
