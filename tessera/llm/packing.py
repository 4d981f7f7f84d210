"""Filling containers of fixed capacity with whole documents.

First-fit decreasing by a tournament tree over the bins' free room, run
independently in randomised groups.  Only (id, piece, size) rows are grouped:
texts never move.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary cuts texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(path: str = TOKENIZER, pattern: str = PATTERN):
    """A column function that counts the tokens of a text; null stays null.

    ``path`` names a file of base-64 tokens and ranks, read once per worker.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("texts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if isinstance(t, str) else None for t in texts], dtype="Int64")

    return F.pandas_udf(count, T.LongType())


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, items taken by falling size (ties in given order).

    A tournament tree holds the greatest free room below each node; the walk to
    the leftmost bin with room takes log n steps.
    """
    n = len(sizes)
    leaves = 1 << max(1, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    out = [0] * n
    for i in sorted(range(n), key=lambda k: -sizes[k]):
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out[i] = node - leaves
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return out


def pack(items: DataFrame, *, item_id: str, size: str | Column, capacity: int, row: str | None = None, group_items: int = 4096, seed: int = 42) -> DataFrame:
    """``item_id, piece, size, container`` for every item.

    An item of more than ``capacity`` is cut into pieces of ``capacity`` and a
    rest; full pieces have containers of their own.  Rests and other items are
    dealt at random into groups of about ``group_items`` and packed there.
    Sizes of zero take a place without room; null ids are kept like any other,
    null sizes are left out.  Repeated ids are separate items of one id.
    ``container`` is unique over all groups; an empty table gives no rows.
    Groups are dealt by a hash of ``row``, a column that tells rows apart and
    stays when a task runs again; without one, by id and size, so that copies of
    one item share a group.
    """
    deal = F.col(row) if row else F.xxhash64(F.col(item_id), F.col(size) if isinstance(size, str) else size)
    sized = items.select(F.col(item_id).alias("item_id"), (F.col(size) if isinstance(size, str) else size).cast("long").alias("whole"), deal.alias("deal"))
    sized = sized.where(F.col("whole").isNotNull())
    n = items.count()
    groups = max(1, -(-n // group_items))
    # The group is dealt by row, not by id: one id may hold a third of all rows.
    dealt = sized.withColumn("group", F.pmod(F.xxhash64("deal", F.lit(seed)), F.lit(groups)))
    full = F.floor(F.col("whole") / capacity)
    sizes = F.concat(
        F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")),
        F.when((F.col("whole") % capacity > 0) | (F.col("whole") == 0), F.array(F.col("whole") % capacity)).otherwise(F.array().cast("array<long>")),
    )
    pieces = dealt.select("item_id", "group", F.posexplode(sizes).alias("piece", "size"))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "item_id", "piece"], ascending=[False, True, True], kind="stable", na_position="last")
        bins = first_fit_decreasing(rows["size"].tolist(), capacity)
        return pd.DataFrame({"item_id": rows["item_id"], "piece": rows["piece"], "size": rows["size"], "container": [(int(key[0]) << 32) + b for b in bins]})

    id_type = sized.schema["item_id"].dataType.simpleString()
    return pieces.groupBy("group").applyInPandas(fill, f"item_id {id_type}, piece int, size long, container long")


def pack_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece, n_tokens, container`` of every document with a text.

    The empty text has no token and still gets a place.
    """
    # Rows are numbered where the table is scanned, so numbers stay if a task runs again.
    rows = spread(docs.select(F.col(doc_id), F.col(text), F.monotonically_increasing_id().alias("__row")))
    counted = rows.select(F.col(doc_id), "__row", token_counter(tokenizer)(F.col(text)).alias("n_tokens"))
    packed = pack(counted, item_id=doc_id, size="n_tokens", capacity=capacity, row="__row")
    return packed.select(F.col("item_id").alias("doc_id"), F.col("piece").cast("int").alias("piece"), F.col("size").alias("n_tokens"), "container")


def container_use(packed: DataFrame, *, size: str, capacity: int) -> DataFrame:
    """``n_containers, n_pieces, used, least_containers, fill``: how full the
    containers are, against the fewest that could hold the same."""
    per = packed.groupBy("container").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s"))
    total = per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.coalesce(F.sum("s"), F.lit(0)).alias("used"))
    least = F.ceil(F.col("used") / capacity)
    return total.select("n_containers", "n_pieces", "used", least.alias("least_containers"), F.round(F.try_divide(F.col("used"), F.col("n_containers") * capacity), 6).alias("fill"))
