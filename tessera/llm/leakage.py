"""Evaluation texts inside a training corpus.

Q-gram lemma filtering: a passage of L characters that occurs with at most k
edits shares at least ``L + 1 - q - k * q`` q-grams with its source, and all of
them lie on diagonals at most k apart.  Shared q-grams are counted per document,
item and overlapping diagonal band; bands that reach the bound are verified by
alignment within the band.  Texts are compared as canonical words (the
consistent form, case folded, words joined by single spaces).

Documents stay where they are scanned: the items' q-grams are broadcast while a
count proves them small, and each task counts bands and aligns within the text
at hand, so nothing of a document is shuffled.  More items than that are joined
on the hash: documents' q-grams are let through by a bitmap of fixed size, heavy
hashes are fragmented, and only texts of documents with a band move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.unify import canonical_words, words_of
from tessera.operators.skew import fragment_replicate_join
from tessera.sources.tables import cut_lineage

#: Items' q-grams may be broadcast up to this many (32 bytes each, with the items'
#: words); beyond it they are joined.
BROADCAST_QGRAMS = 1_000_000
#: Bits of the bitmap that lets documents' q-grams through to the join: 16 MB.
BITMAP_BITS = 1 << 27
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Entries counted at once, the least band number, and bands aligned at once.
_ENTRIES, _OFFSET, _SPAN = 1 << 20, 1 << 39, 16


def qgram_hashes(text: str, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram of ``text`` by its code points."""
    return _hashes(_code_points(text), q)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``q`` points, from runs of 1, 2, 4, ..."""
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    part = points.astype(np.uint64)
    part *= np.uint64(0xD6E8FEB86659FD93)
    part ^= part >> np.uint64(32)
    done, out, size, base = 0, None, 1, _BASE
    old = np.seterr(over="ignore")  # numbers wrap
    while size <= q:  # part: runs of ``size``; base: the multiplier to that power
        if q & size:
            tail = part[done : done + n]
            out = tail.copy() if out is None else out * base + tail
            done += size
        if 2 * size <= q:
            part = part[:-size] * base + part[size:]
            base = np.multiply(base, base, dtype=np.uint64)
        size *= 2
    np.seterr(**old)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


@dataclass(frozen=True)
class Passages:
    """The shortest passage that counts, in words and in characters."""

    words: int
    chars: int
    edits: int

    @property
    def q(self) -> int:
        return max(2, min(12, self.chars // (self.edits + 1) - 1))

    @property
    def band(self) -> int:
        """Half the width of a band; neighbours overlap by this much, so that
        diagonals at most ``edits`` apart lie together in one of them."""
        return self.edits + 1


def canonical_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, item_words`` of items with an id and a text; one row per
    distinct (id, words)."""
    return items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("item_words")).where(
        F.col("item_id").isNotNull() & F.col("item_words").isNotNull()
    ).distinct()


def with_shortest(items: DataFrame, n_words: int) -> DataFrame:
    """Items of at least ``n_words`` words with ``least``, the characters of
    their shortest run of so many words."""
    words = F.split("item_words", " ")
    n = F.size(words)
    spans = F.transform(F.sequence(F.lit(1), n - (n_words - 1)), lambda i: F.length(F.array_join(F.slice(words, i, n_words), " ")))
    return items.where(n >= n_words).withColumn("least", F.array_min(spans))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def item_qgrams(items: DataFrame, q: int) -> DataFrame:
    """``h, item_id, ipos`` of every q-gram of the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, t in zip(b["item_id"], b["item_words"]):
                h = qgram_hashes(t, q)
                yield pd.DataFrame({"h": h, "item_id": [i] * len(h), "ipos": np.arange(len(h), dtype=np.int32)})

    return items.select("item_id", "item_words").mapInPandas(run, f"h long, item_id {_kind(items, 'item_id')}, ipos int")


class ItemIndex:
    """The items' q-grams by hash: entries ``starts[k]`` to ``starts[k + 1]`` of
    ``items`` and ``positions`` belong to ``hashes[k]``."""

    def __init__(self, words: list[str], least: list[int], passages: Passages):
        self.words, self.passages = words, passages
        # The lemma's bound, by the item's own shortest passage.
        self.bound = np.maximum(1, np.array(least, dtype=np.int64) + 1 - passages.q - passages.edits * passages.q)
        grams = [qgram_hashes(t, passages.q) for t in words]
        h = np.concatenate([*grams, np.empty(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.starts = np.append(first, len(h))
        self.items = np.repeat(np.arange(len(words)), [len(g) for g in grams])[order]
        self.positions = np.concatenate([*[np.arange(len(g)) for g in grams], np.empty(0, np.int64)])[order]
        # Most q-grams of a text are in no item: a bitmap turns them away.
        self.mask = np.int64((1 << max(16, int(len(self.hashes) * 32).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, dtype=bool)
        self.seen[self.hashes & self.mask] = True

    def bands(self, doc: str) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of the document's bands that reach the bound."""
        h = qgram_hashes(doc, self.passages.q)
        pos = np.flatnonzero(self.seen[h & self.mask])
        if not len(pos) or not len(self.hashes):
            return []
        at = np.searchsorted(self.hashes, h[pos])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h[pos]
        at, pos = at[hit], pos[hit]
        if not len(at):
            return []
        n = self.starts[at + 1] - self.starts[at]
        keys, counts = [], []
        # Entries of repetitive texts are counted in parts of bounded size.
        ends = np.cumsum(n)
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(ends // _ENTRIES)) + 1):
            m = n[part]
            entry = np.repeat(self.starts[at[part]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            b = (np.repeat(pos[part], m) - self.positions[entry]) // self.passages.band + _OFFSET
            item = self.items[entry] << 40
            k, c = np.unique(np.concatenate([item + b, item + b - 1]), return_counts=True)
            keys.append(k)
            counts.append(c)
        key, shared = keys[0], counts[0]
        if len(keys) > 1:
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            shared = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        good = key[shared >= self.bound[key >> 40]]
        return [(int(k >> 40), int(((k & (1 << 40) - 1) - _OFFSET) * self.passages.band)) for k in good]


def best_match(doc: str, item: str, least: int, diagonals: list[int], passages: Passages) -> tuple[int, bool]:
    """(characters matched, whether enough consecutive words agree) over bands.

    Bands that overlap are aligned as one region of diagonals."""
    score, exact, e = 0, False, passages.edits
    spans: list[list[int]] = []
    for low in sorted(diagonals):
        if spans and low <= spans[-1][1] and low - spans[-1][0] <= _SPAN * passages.band:
            spans[-1][1] = low + 2 * passages.band
        else:
            spans.append([low, low + 2 * passages.band])
    for low, high in spans:
        # A passage of ``least`` characters keeps all but one for each edit.
        found = aligned_chars(doc, item, low - e, high + e, e, least - e)
        if found:
            score = max(score, found)
            # The region, out to whole words.
            start = doc.rfind(" ", 0, max(0, low - e)) + 1
            end = doc.find(" ", min(len(doc), max(0, high + e + len(item))))
            exact = exact or common_run(doc[start : end if end >= 0 else len(doc)].split(" "), item.split(" "), passages.words)
    return score, exact


def _pair_schema(docs: DataFrame, items: DataFrame) -> str:
    return f"doc_id {_kind(docs, 'doc_id')}, item_id {_kind(items, 'item_id')}, score int, exact boolean"


def _pairs_by_broadcast(docs: DataFrame, items: DataFrame, passages: Passages) -> DataFrame:
    """Bands are counted and aligned in the task that holds the document."""
    # Proven small by the caller's count of q-grams.
    held = [(r["item_id"], r["item_words"], r["least"]) for r in items.select("item_id", "item_words", "least").collect()]
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, words, least = zip(*sent.value)
        index = ItemIndex(list(words), list(least), passages)
        cache: dict[str, str] = {}
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                doc = canonical_words(text, cache)
                by_item: dict[int, list[int]] = {}
                for k, low in index.bands(doc):
                    by_item.setdefault(k, []).append(low)
                for k, lows in by_item.items():
                    score, exact = best_match(doc, words[k], least[k], lows, passages)
                    if score:
                        rows.append((doc_id, ids[k], score, exact))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "exact"])

    return docs.mapInPandas(run, _pair_schema(docs, items))


def _bit(h: Column) -> Column:
    """Number of the bit of a hash, from 1 as bitmaps count."""
    return F.pmod(h, F.lit(BITMAP_BITS)) + 1


def _bitmap(grams: DataFrame) -> np.ndarray:
    """A bit for every low part of a hash; at most BITMAP_BITS / 8 bytes."""
    rows = grams.groupBy(F.bitmap_bucket_number(_bit(F.col("h"))).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_bit(F.col("h")))).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        bits = np.frombuffer(r["bits"], dtype=np.uint8)
        at = (r["k"] - 1) * len(bits)
        out[at : at + len(bits)] = bits[: len(out) - at]
    return out


def _document_qgrams(docs: DataFrame, bitmap: np.ndarray, q: int) -> DataFrame:
    """``h, doc_id, dpos`` of the documents' q-grams that the bitmap lets through."""
    sent, bits = docs.sparkSession.sparkContext.broadcast(bitmap), BITMAP_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                h = qgram_hashes(canonical_words(text, cache), q)
                low = h & np.int64(bits - 1)
                pos = np.flatnonzero(sent.value[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                if len(pos):
                    yield pd.DataFrame({"h": h[pos], "doc_id": [doc_id] * len(pos), "dpos": pos.astype(np.int32)})

    return docs.mapInPandas(run, f"h long, doc_id {_kind(docs, 'doc_id')}, dpos int")


def _pairs_by_join(docs: DataFrame, items: DataFrame, grams: DataFrame, passages: Passages) -> DataFrame:
    """The same pairs for items of any number, over a join on the q-grams' hash."""
    grams = cut_lineage(grams)
    hits = fragment_replicate_join(cut_lineage(_document_qgrams(docs, _bitmap(grams), passages.q)), grams, "h")
    w = passages.band
    at = F.floor((F.col("dpos") - F.col("ipos")) / F.lit(w))
    # Combined before the shuffle; a band's rows are counted by (document, item, band).
    counted = hits.select("doc_id", "item_id", F.explode(F.array(at, at - 1)).alias("b")).groupBy("doc_id", "item_id", "b").agg(F.count(F.lit(1)).alias("shared"))
    bound = F.greatest(F.lit(1), F.col("least") + 1 - passages.q - passages.edits * passages.q)
    kept = counted.join(items.select(F.col("item_id"), "least", "item_words"), "item_id").where(F.col("shared") >= bound)
    bands = cut_lineage(kept.groupBy("doc_id", "item_id", "item_words", "least").agg(F.collect_list((F.col("b") * w).cast("long")).alias("lows")))
    found = bands.join(docs, "doc_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}
        for b in batches:
            rows = []
            for doc_id, item_id, item, least, lows, text in zip(b["doc_id"], b["item_id"], b["item_words"], b["least"], b["lows"], b["text"]):
                score, exact = best_match(canonical_words(text, cache), item, int(least), [int(x) for x in lows], passages)
                if score:
                    rows.append((doc_id, item_id, score, exact))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "exact"])

    return found.select("doc_id", "item_id", "item_words", "least", "lows", "text").mapInPandas(verify, _pair_schema(docs, items))


def aligned_chars(doc: str, item: str, low: int, high: int, edits: int, need: int) -> int:
    """Characters of ``item`` that match in the best alignment with ``doc`` of at
    most ``edits`` edits on diagonals low..high; 0 where that is under ``need``.

    Runs of matches along each diagonal of the band are computed at once.  Of
    the ``edits + 1`` runs of an alignment one is at least an equal share of
    ``need``, so alignments grow from such runs, over one edit after another, to
    the furthest character on the diagonal that the edit leads to.
    """
    d = np.frombuffer(doc.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    t = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n, width = len(t), high - low + 1
    pad = np.zeros(n + width, dtype=np.uint32)
    a, b = max(0, low), min(len(d), low + len(pad))
    if b > a:
        pad[a - low : b - low] = d[a:b]
    equal = np.lib.stride_tricks.sliding_window_view(pad, width)[:n] == t[:, None]
    rows = np.arange(n)[:, None]
    ahead = np.minimum.accumulate(np.where(equal, n, rows)[::-1])[::-1] - rows  # matches from a row on
    behind = rows - np.maximum.accumulate(np.where(equal, -1, rows))  # matches up to a row

    def forward(r: int, c: int, k: int) -> int:
        best = 0
        if k:
            for r2, c2 in ((r + 1, c), (r, c + 1), (r + 1, c - 1)):  # another, an extra, a missing character
                if 0 <= c2 < width and r2 < n:
                    run = int(ahead[r2, c2])
                    best = max(best, run + forward(r2 + run, c2, k - 1))
        return best

    def backward(r: int, c: int, k: int) -> int:
        best = 0
        if k:
            for r2, c2 in ((r - 1, c), (r, c - 1), (r - 1, c + 1)):
                if 0 <= c2 < width and r2 > 0:
                    run = int(behind[r2 - 1, c2])
                    best = max(best, run + backward(r2 - run, c2, k - 1))
        return best

    starts = (ahead >= -(-need // (edits + 1))) & (behind == 1)
    best = 0
    for r, c in zip(*np.nonzero(starts)):
        run = int(ahead[r, c])
        for k in range(edits + 1):
            best = max(best, backward(int(r), int(c), k) + run + forward(int(r) + run, int(c), edits - k))
    return best if best >= need else 0


def common_run(region: list[str], item: list[str], n: int) -> bool:
    """Whether ``region`` holds ``n`` consecutive words of ``item``."""
    windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    return any(tuple(region[i : i + n]) in windows for i in range(len(region) - n + 1))


def leaked_passages(docs: DataFrame, items: DataFrame, *, min_words: int = 13, edits: int = 1) -> DataFrame:
    """``doc_id, item_id, score, exact`` of documents that hold a passage of an item.

    ``docs`` has ``doc_id, text`` and ``items`` has ``item_id, text``; other
    columns are not read.  A pair counts if a region aligns with a passage of at
    least ``min_words`` words with at most ``edits`` edits; ``exact`` says that
    ``min_words`` consecutive words agree.  ``score`` is the number
    of the item's characters that match.  Null ids and null or empty texts give no pair, items of
    fewer words neither; repeated rows count once.  Ids keep their types.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    items = canonical_items(items.select("item_id", "text"), "item_id", "text")
    items = cut_lineage(with_shortest(items, min_words))
    seen = items.agg(F.min("least").alias("least"), F.sum(F.length("item_words")).alias("chars")).first()
    passages = Passages(min_words, seen["least"] or min_words * 2 - 1, edits)
    if (seen["chars"] or 0) <= BROADCAST_QGRAMS:  # there are fewer q-grams than characters
        pairs = _pairs_by_broadcast(docs, items, passages) if seen["chars"] else docs.where(F.lit(False)).select("doc_id", F.lit(None).cast(_kind(items, "item_id")).alias("item_id"), F.lit(0).alias("score"), F.lit(False).alias("exact"))
    else:
        pairs = _pairs_by_join(docs, items, item_qgrams(items, passages.q), passages)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("exact").alias("exact"))
