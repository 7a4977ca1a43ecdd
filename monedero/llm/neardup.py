"""Near-duplicates from bottom-k sketches of one hash function.

A document is the set of its hashed word shingles; its sketch holds the k smallest
hashes. Documents with equal sets are one class, and only classes are compared.

1. Inverted lists of the first retained values name candidates. A pair that reaches
   the threshold shares nearly all of them, so lists of one document and documents
   that share too few values are done at once.
2. In a few rounds every list links its members to a few hubs: of each part of the
   list, parts drawn anew each round, the document whose values are the most common.
   In a group of near copies that is one near the middle, which most others reach.
   Overlap counts and the union sketch's estimate filter these pairs, exact Jaccard
   on the full sets confirms them, and the components found so far are merged. A
   group of n near copies costs a few n pairs, not n^2.
3. Then every pair of documents of different components that share a value is tried.
   Values that would make too many such pairs (passages that many texts share) are
   ordered behind all others. Documents whose sketch holds several of those are
   indexed by the exact prefix of their full set in that order instead (the shortest
   that any pair over the threshold must share a value in), so no link is lost. They
   meet hubs of these lists first, chosen by how common all their values are: the
   few retained ones leave the middle of a large group level with many others.

Nothing of the corpus is collected or broadcast by hint; lists are joined, never
gathered, and hubs' joins are left to Spark's splitting of skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monedero.llm.common import Scratch, batch, hash_words, mix64, split_words
from monedero.llm.components import components

K = 64
#: Retained values that are indexed.
INDEXED = 24
HUB_ROUNDS = 2
#: Hubs of a list in a round.
HUBS = 4
#: Contractions after a hub round; what they leave apart costs candidates, not links.
MERGE_ROUNDS = 2
#: Pairs of different components that one value may name before it is ordered last.
HOT_PAIRS = 300
#: Earlier values that an entry of an exact prefix carries, so that a pair is met once.
_EARLIER = 8
#: Bits of the retained values that the estimate compares.
_SHORT = 31
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles of `width` words.

    A text of fewer words is one shingle; without words the set is empty.
    """
    h = hash_words(split_words(text))
    if not len(h):
        return h
    take = min(width, len(h))
    out = np.full(len(h) - take + 1, take, np.uint64)
    for k in range(take):
        out = mix64(out * _ODD + h[k : k + len(out)])
    return np.unique(out >> np.uint64(1))


_SKETCH = pa.schema(
    [("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.list_(pa.int64()))]
)
_SET = pa.schema([("id", pa.int64()), ("set", pa.binary())])


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (sums that identify the set) and the sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            sums = [
                [len(s) for s in sets],
                [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets],
                [int(mix64(s + _ODD).sum(dtype=np.uint64).view(np.int64)) for s in sets],
                [s[:k].view(np.int64) for s in sets],
            ]
            own = batch(_SKETCH, *sums)
            yield pa.RecordBatch.from_arrays([b.column(0), *own.columns], ["doc_id", *_SKETCH.names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set) of the documents in `ids`, the set as sorted 8-byte integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], schema=_SET)

    picked = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id")
    return picked.select("id", "text").mapInArrow(run, "id long, set binary")


def _level(pairs: Column) -> Column:
    """0 for a value that names few pairs; each doubling beyond that is one level later in the order."""
    return F.when(pairs > HOT_PAIRS, F.floor(F.log2(pairs / HOT_PAIRS)).cast("int") + 1).otherwise(F.lit(0))


def _near_size(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


class _Search:
    """The tables one search shares between its steps."""

    def __init__(self, docs: DataFrame, scratch: Scratch, width: int, percent: int):
        self.scratch, self.percent = scratch, percent
        docs = docs.select("doc_id", "text")
        self.rows = scratch.stage(sketches(docs, width))
        same = ["n", "k1", "k2"]
        self.classes = scratch.stage(
            self.rows.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("id"))
        )
        self.sketch = (
            self.rows.withColumnRenamed("doc_id", "id").join(self.classes, ["id", *same]).select("id", "n", "sketch")
        )
        listed = F.explode(F.slice("sketch", 1, INDEXED)).alias("value")
        self.index = scratch.stage(
            self.sketch.select("id", "n", F.least("n", F.lit(INDEXED)).cast("int").alias("e"), listed).distinct()
        )
        shared = self.index.groupBy("value").agg(F.count("*").alias("_n")).where("_n > 1").withColumnRenamed("_n", "holders")
        entries = scratch.stage(self.index.join(shared, "value"))
        enough = F.greatest(F.lit(1), F.least(F.lit(8), F.expr("e div 3")))
        active = scratch.stage(
            entries.groupBy("id", "e")
            .agg(F.count("*").alias("_n"), F.sum("holders").alias("weight"))
            .where(F.col("_n") >= enough)
            .select("id", "weight")
        )
        self.entries = scratch.stage(entries.drop("holders").join(active, "id"))
        scratch.drop(entries)
        self.sets = scratch.stage(full_sets(docs, active.select("id"), width))
        self.edges = None
        self.comps = None

    def named(self) -> DataFrame:
        """The indexed entries with the component of their document so far."""
        if self.comps is None:
            return self.entries.withColumn("comp", F.col("id"))
        return (
            self.entries.join(self.comps, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
        )

    def confirm(self, pairs: DataFrame, rounds: int | None = None) -> None:
        """Estimate, then verify candidate pairs (a, b); merge what is linked."""
        pairs = self.scratch.stage(pairs)
        # The leading bits keep the order of the values and nearly all differences.
        short = self.sketch.select("id", "n", F.transform("sketch", lambda v: F.shiftright(v, 63 - _SHORT).cast("int")).alias("s"))
        near = pairs.join(short.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a").join(
            short.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b"
        )
        union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
        both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
        # The estimate may fall short by six deviations; only whole unions are counted exactly.
        whole = F.col("na") + F.col("nb") <= K
        least = F.when(whole, F.lit(self.percent / 100 - 1e-9)).otherwise(self.percent / 100 - 0.3)
        close = self.scratch.stage(
            near.withColumn("u", union).where(both >= least * F.size("u")).select("a", "b")
        )
        sets = self.sets
        joined = close.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b"
        )
        new = joined.select("a", "b", "x", "y").mapInArrow(_verifier(self.percent), "a long, b long")
        edges = self.scratch.stage(new if self.edges is None else new.union(self.edges))
        self.scratch.drop(pairs, close)
        self.edges, self.comps = edges, components(edges, self.scratch, rounds)

    def link_to_hubs(self, round_: int) -> None:
        entries = self.named()
        drawn = F.xxhash64(F.lit(round_), "id")
        hub = F.max(F.struct("weight", drawn.alias("h"), "id", "comp", "n"))
        hubs = entries.groupBy("value", F.pmod(drawn, F.lit(HUBS)).alias("part")).agg(hub.alias("hub"))
        hubs = hubs.select("value", F.col("hub.id").alias("b"), F.col("hub.comp").alias("comp_b"), F.col("hub.n").alias("nb"))
        enough = F.greatest(F.lit(1), F.least(F.lit(4), F.expr("e div 4")))
        pairs = (
            entries.join(hubs, "value")
            .where((F.col("comp") != F.col("comp_b")) & _near_size("n", "nb", self.percent))
            .groupBy("id", "e", "b")
            .agg(F.count("*").alias("_n"))
            .where(F.col("_n") >= enough)
            .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
            .distinct()
        )
        self.confirm(pairs, MERGE_ROUNDS)

    def link_rest(self) -> None:
        """Try all pairs of different components that share an indexed value."""
        entries = self.scratch.stage(self.named())
        counts = entries.groupBy("value", "comp").agg(F.count("*").alias("c")).groupBy("value").agg(
            F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same")
        )
        cross = (F.col("all") * F.col("all") - F.col("same")) / 2
        values = self.scratch.stage(counts.where(cross > 0).select("value", _level(cross).alias("level")))
        open_ = self.scratch.stage(entries.join(values, "value"))
        hot = values.where("level > 0")
        special = self._mostly_hot(hot)
        if not special.isEmpty():
            # Their other values may be as common as those that happen to be retained.
            hot = self.scratch.stage(hot.union(self._hot_within(special)).groupBy("value").agg(F.max("level").alias("level")))
            special = self._mostly_hot(hot)
        plain = open_.join(hot, "value", "left_anti").join(special, "id", "left_anti")
        other = plain.select("value", F.col("id").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("nb"), F.col("e").alias("eb"))
        pairs = (
            plain.join(other, "value")
            .where((F.col("id") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & _near_size("n", "nb", self.percent))
            .groupBy("id", "b", F.least("e", "eb").alias("e"))
            .agg(F.count("*").alias("_n"))
            .where((F.col("_n") > 1) | (F.col("e") < 16))
            .select(F.col("id").alias("a"), "b")
        )
        if not special.isEmpty():
            prefix = self._prefixes(special, hot)
            self.confirm(self._hub_pairs(prefix, hot))
            pairs = pairs.union(self._special_pairs(prefix, special, hot))
        self.confirm(pairs.distinct())

    def _mostly_hot(self, hot: DataFrame) -> DataFrame:
        """Documents of which too few indexed values are left without the hot ones."""
        limit = F.greatest(F.lit(0), F.least(F.lit(4), F.expr("e div 6")))
        counts = self.entries.join(hot, "value").groupBy("id", "e").agg(F.count("*").alias("_n"))
        return self.scratch.stage(counts.where(F.col("_n") > limit).select("id").distinct())

    def _hot_within(self, special: DataFrame) -> DataFrame:
        """Values of the full sets of `special` that name too many pairs of components."""
        whole = self.sets.join(special, "id").mapInArrow(_explode_set, "id long, n long, value long")
        counts = self._with_comp(whole, self.comps).groupBy("value", "comp").agg(F.count("*").alias("c"))
        counts = counts.groupBy("value").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"))
        cross = (F.col("all") * F.col("all") - F.col("same")) / 2
        return counts.select("value", _level(cross).alias("level")).where("level > 0")

    def _prefixes(self, special: DataFrame, hot: DataFrame) -> DataFrame:
        """The exact prefixes of documents that share mostly hot values; `weight` says how hot their full sets are."""
        whole = self.sets.join(special, "id").mapInArrow(_explode_set, "id long, n long, value long")
        ranked = whole.join(hot, "value", "left").select(
            "id", "n", F.struct(F.coalesce("level", F.lit(0)).alias("level"), "value").alias("at")
        )
        # Sets over the threshold share a value among the first n - ceil(t * n) + 1 of either.
        length = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1
        prefix = (
            ranked.groupBy("id", "n")
            .agg(F.sort_array(F.collect_list("at")).alias("all"), F.sum("at.level").alias("weight"))
            .select("id", "n", "weight", F.slice("all.value", F.lit(1), length.cast("int")).alias("all"))
            .select("id", "n", "weight", F.slice("all", 1, _EARLIER).alias("early"), F.posexplode("all").alias("place", "value"))
            .withColumn("early", F.slice("early", F.lit(1), F.least("place", F.lit(_EARLIER))))
        )
        return self.scratch.stage(prefix)

    def _hub_pairs(self, prefix: DataFrame, hot: DataFrame) -> DataFrame:
        """Candidates of which one is a hub: of each part of a hot value's list, the document of the hottest set."""
        part = F.pmod(F.xxhash64("id"), F.lit(HUBS)).alias("part")
        hub = F.max(F.struct("weight", "id")).alias("hub")
        hubs = prefix.join(hot, "value", "left_semi").groupBy("value", part).agg(hub).select("hub.id").distinct()
        entries = self.scratch.stage(self._with_comp(prefix, self.comps))
        return self._prefix_pairs(entries, entries.join(hubs, "id", "left_semi"), F.col("id") != F.col("id_b"))

    def _special_pairs(self, prefix: DataFrame, special: DataFrame, hot: DataFrame) -> DataFrame:
        """All candidates of documents that share mostly hot values."""
        prefix = self.scratch.stage(self._with_comp(prefix, self.comps).withColumn("special", F.lit(True)))
        usual = self._with_comp(self.index.join(special, "id", "left_anti").select("value", "id", "n"), self.comps)
        usual = usual.join(hot, "value", "left_anti").select(
            "id", "n", F.expr("cast(array() as array<bigint>)").alias("early"), F.lit(0).alias("place"), "value", "comp",
            F.lit(False).alias("special"),
        )
        other = usual.union(prefix.select(*usual.columns))
        return self._prefix_pairs(prefix, other, ~F.col("special_b") | (F.col("id") < F.col("id_b")))

    def _prefix_pairs(self, prefix: DataFrame, other: DataFrame, once: Column) -> DataFrame:
        """Pairs of different components that meet in `value`, as far as `once` lets them."""
        other = other.select("value", *(F.col(c).alias(f"{c}_b") for c in other.columns if c != "value"))
        # A pair is met at its first common value: what follows there must reach the
        # overlap that the threshold asks for, and nothing before may be common.
        need = (F.col("n") + F.col("n_b")) * self.percent / (100 + self.percent) - 1e-6
        room = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
        return (
            prefix.join(other, "value")
            .where(
                (F.col("comp") != F.col("comp_b"))
                & once
                & _near_size("n", "n_b", self.percent)
                & (room >= need)
                & ~F.arrays_overlap("early", "early_b")
            )
            .select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b"))
            .distinct()
        )

    @staticmethod
    def _with_comp(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
        if comps is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                inter = int((y[at] == x).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in b.columns[:2]], ["a", "b"])

    return run


def _explode_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc, raw in zip(b.column(0), b.column(1), strict=True):
            values = np.frombuffer(raw.as_buffer(), np.int64)
            size = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, doc.as_py())), pa.array(np.full(size, size)), pa.array(values)], ["id", "n", "value"]
            )


def near_duplicates(docs: DataFrame, scratch: Scratch, *, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of `docs` (doc_id, text).

    Two documents are linked if their shingle sets' Jaccard similarity is at least
    `percent` hundredths; a component is named by its smallest doc_id, whose document
    is kept. Null and empty texts have an empty set and are linked with nothing. Rows
    that share a doc_id and a text are one document. A row without doc_id has no
    component and is kept. An empty table gives no rows; other columns play no part.
    """
    search = _Search(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch, width, percent)
    for round_ in range(HUB_ROUNDS):
        search.link_to_hubs(round_)
    search.link_rest()
    out = (
        search.rows.join(search.classes, ["n", "k1", "k2"], "left")
        .join(search.comps, "id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull()))
    )
    out = scratch.stage(out)
    scratch.close(out)
    return out


def oracle_sql(width: int = 4, percent: int = 80) -> str:
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {width} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {width - 2}), lambda i: array_to_string(words[i:i + {width - 1}], ' '))) END AS shingles
  FROM w
),
x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b
  WHERE 100 * common >= {percent} * (len(sa.shingles) + len(sb.shingles) - common)
),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
