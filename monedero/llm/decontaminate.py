"""Benchmark decontamination by spaced seeds.

A fixed mask keeps some of a few consecutive words and ignores the others, so a seed
still matches where an ignored word was replaced. Test items are cut into bounded
blocks; a block's seeds and words are broadcast, every document meets them in its own
task, and each hit names an item and a diagonal (the offset between both). Around the
hits the words are compared one by one. An item leaks where at least the given share of
its words stands in the document, in place, or where an overlap of some length does;
neighbouring diagonals of an item, which inserted or dropped words make, count together.
Documents are neither shuffled nor cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import batch, hash_words, mix64, plain_words, tune

#: Kept (1) and ignored (0) places; five are kept.
MASKS = ("11111", "1101011", "110010011")
SIMILARITY = 0.8
#: Words of an overlap that leak by themselves, whatever the item's length.
OVERLAP_WORDS = 13
#: Items of up to so many words have masks for every placement of the words that may differ.
SHORT_ITEM = 10
#: Diagonals of one item that count together lie this close.
SHIFT = 8
#: Equal words in a row that count on a neighbouring diagonal.
RUN = 3
#: Words of test items that travel to the tasks at once.
BLOCK_WORDS = 500_000
#: Hits that are expanded at once.
_SLICE = 1 << 16
_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def short_masks(n: int, similarity: float) -> list[str]:
    """Masks as long as an item of `n` words, one for every set of words that may differ."""
    free = int(n * (1 - similarity) + 1e-9)
    return ["".join("0" if i in gone else "1" for i in range(n)) for gone in combinations(range(n), free)]


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed that starts at every word where the mask fits."""
    size = max(0, len(words) - len(mask) + 1)
    out = np.full(size, len(mask) + mask.count("1"), np.uint64)
    for k, kept in enumerate(mask):
        if kept == "1":
            out = out * _ODD + words[k : k + size]
            out ^= out >> np.uint64(31)
    return mix64(out)


class Block:
    """Seeds of some test items, sorted, with the item and place of each."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float = SIMILARITY, masks=MASKS):
        self.items, self.similarity = items, similarity
        short = {n: short_masks(n, similarity) for n in {len(w) for _, w in items} if 0 < n <= SHORT_ITEM}
        of_length = {m: n for n, own in sorted(short.items()) for m in own}
        self.tables = []
        for mask in [*masks, *(m for m in of_length if m not in masks)]:
            own = [(i, w) for i, (_, w) in enumerate(items) if of_length.get(mask) == len(w) or (mask in masks and len(w) > SHORT_ITEM)]
            if not own:
                continue
            got = [_seeds(w, mask) for _, w in own]
            seeds = np.concatenate(got)
            item = np.concatenate([np.full(len(g), i) for (i, _), g in zip(own, got, strict=True)])
            place = np.concatenate([np.arange(len(g)) for g in got])
            order = np.argsort(seeds, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[seeds >> np.uint64(64 - _BITS)] = True
            self.tables.append((mask, seeds[order], item[order], place[order], seen))

    def diagonals(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each item with a hit, where it would start in the document, ascending.

        Hits are expanded slice by slice and kept once per diagonal, so words that
        repeat thousands of times need no more memory than the text has words.
        """
        width = 2 * (len(words) + 1) + max((len(w) for _, w in self.items), default=0)
        codes = np.zeros(0, np.int64)
        for mask, seeds, item, place, seen in self.tables:
            own = _seeds(words, mask)
            at = np.flatnonzero(seen[own >> np.uint64(64 - _BITS)])
            first = np.searchsorted(seeds, own[at], "left")
            count = np.searchsorted(seeds, own[at], "right") - first
            ends = np.cumsum(count)
            done = 0
            while done < len(at):
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _SLICE, "right")))
                n = count[done:upto]
                rows = np.repeat(first[done:upto], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(at[done:upto], n) - place[rows]
                codes = np.union1d(codes, item[rows] * width + start + width // 2)
                done = upto
        out: dict[int, np.ndarray] = {}
        if len(codes):
            which = (codes // width).tolist()
            cuts = np.flatnonzero(np.diff(codes // width)) + 1
            for i, starts in zip([which[0], *(which[c] for c in cuts)], np.split(codes % width - width // 2, cuts), strict=True):
                out[i] = starts
        return out

    def leaks(self, words: np.ndarray) -> list[tuple]:
        """(item, start, matches, words compared, item's words, whole) of each leaked item's best place."""
        out = []
        for i, starts in sorted(self.diagonals(words).items()):
            item_id, item = self.items[i]
            best = None
            for group in np.split(starts, np.flatnonzero(np.diff(starts) > SHIFT) + 1):
                for found, single in self._places(item, words, group.tolist()):
                    rank = (found[4], found[1] if found[4] else found[2], found[1], single, -found[0])
                    if best is None or rank > best[0]:
                        best = rank, found
            if best:
                start, matches, compared, whole_words, whole = best[1]
                out.append((item_id, start, matches, compared, whole_words, whole))
        return out

    def _places(self, item: np.ndarray, words: np.ndarray, starts: list[int]) -> Iterator[tuple]:
        """Leaks of one item on diagonals that lie close together, and whether one makes it alone."""
        together = np.zeros(len(item), bool)
        first = starts[0]
        for start in starts:
            lo, hi = max(0, -start), min(len(item), len(words) - start)
            same = np.zeros(len(item), bool)
            same[lo:hi] = item[lo:hi] == words[start + lo : start + hi]
            yield from ((leak, True) for leak in self._judge(same, start))
            if len(starts) > 1:
                if start - first > max(SHIFT, len(item) // 2):
                    yield from ((leak, False) for leak in self._judge(together, first))
                    together[:], first = False, start
                together |= _runs(same)
        if len(starts) > 1:
            yield from ((leak, False) for leak in self._judge(together, first))

    def _judge(self, same: np.ndarray, start: int) -> Iterator[tuple]:
        """The leak these equal words make, whole or in part, if any."""
        n, matches = len(same), int(same.sum())
        if matches >= self.similarity * n - 1e-9:
            yield start, matches, n, n, True
        elif matches >= self.similarity * OVERLAP_WORDS - 1e-9:
            lo, hi = longest_part(same, self.similarity)
            if hi - lo >= OVERLAP_WORDS:
                yield start, int(same[lo:hi].sum()), hi - lo, n, False


def _runs(same: np.ndarray) -> np.ndarray:
    """The equal words that stand in a row of at least `RUN`."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    out = np.zeros(len(same), bool)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= RUN:
            out[a:b] = True
    return out


def longest_part(same: np.ndarray, share: float) -> tuple[int, int]:
    """The longest stretch between two set words, the first among equals, that is set to `share`."""
    sums = np.concatenate([[0.0], np.cumsum(same - share)]) + np.arange(len(same) + 1) * 1e-12
    begins = np.where(np.append(same, False), sums, np.inf)
    ends = np.where(np.append(False, same), sums, -np.inf)
    # Only a new minimum can begin it, and only a maximum from the right can end it.
    lows = np.flatnonzero(begins < np.concatenate([[np.inf], np.minimum.accumulate(begins)[:-1]]))
    right = np.maximum.accumulate(ends[::-1])[::-1]
    best, end = (0, 0), 0
    for lo in lows.tolist():
        end = max(end, lo)
        while end + 1 < len(right) and right[end + 1] >= sums[lo]:
            end += 1
        if end - lo > best[1] - best[0]:
            best = lo, end
    return best


def _blocks(spark, items: DataFrame, block_words: int, similarity: float) -> Iterator:
    """Broadcast blocks of test items; the items of a block are bounded by their words."""
    sized = items.select("item_id", "text").where("item_id is not null and text is not null")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // (block_words * 4)))
    for no in range(parts):
        rows = sized.where(F.pmod(F.xxhash64(F.lit(13), "item_id"), F.lit(parts)) == no).collect()
        found = [(r["item_id"], hash_words(plain_words(r["text"]))) for r in rows]
        found = [x for x in sorted(found, key=lambda x: x[0]) if len(x[1])]
        yield spark.sparkContext.broadcast(Block(found, similarity))


_LEAK = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "item_id", "start", "matches", "words", "item_words")] + [("whole", pa.bool_())]
)
_LEAK_TYPE = "doc_id long, item_id long, start long, matches long, words long, item_words long, whole boolean"


def leaks(
    docs: DataFrame, items: DataFrame, *, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc_id, item_id, start, matches, words, item_words, whole, similarity of every leak.

    Words are lower-cased and freed of ASCII punctuation; `start` counts them from 0
    and is negative where a document begins inside the item. `whole` leaks compare all
    words of the item; else `words` is the length of the overlap, `OVERLAP_WORDS` at
    least. The best place counts, whole before part, the first among equals. Null or empty texts and items leak nothing; repeated
    documents or items give repeated rows. Other columns play no part.
    """
    spark = tune(docs.sparkSession)
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for shared in _blocks(spark, items.withColumn("item_id", F.col("item_id").cast("long")), block_words, similarity):
        found = rows.mapInArrow(_finder(shared), _LEAK_TYPE)
        out = found if out is None else out.union(found)
    return out.withColumn("similarity", F.col("matches") / F.col("words"))


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                (doc, *leak)
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for leak in shared.value.leaks(hash_words(plain_words(text)))
            ]
            if out:
                yield batch(_LEAK, *map(list, zip(*out, strict=True)))

    return run


def clean(
    docs: DataFrame, items: DataFrame, *, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents without any leak, whole or in part, with all their columns."""
    spark = tune(docs.sparkSession)
    at = docs.columns.index("text")
    for shared in _blocks(spark, items.withColumn("item_id", F.col("item_id").cast("long")), block_words, similarity):
        docs = docs.mapInArrow(_cleaner(shared, at), docs.schema)
    return docs


def _cleaner(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [not shared.value.leaks(hash_words(plain_words(t))) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run
