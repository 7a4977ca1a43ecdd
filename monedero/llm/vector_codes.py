"""Vector compression by product codes, assigned with the equal-average search.

Vectors become integers and are cut into consecutive parts; each part is replaced by
the index of the nearest entry of its codebook. Entries are kept sorted by the sum of
their components. A part starts at its own sum and expands outward on both sides; by
Cauchy and Schwarz no entry is nearer than (difference of sums)^2 / dimension, so the
search ends as soon as that bound strictly exceeds the best distance.

Training assigns all rows and adds up components per entry inside the tasks, so only
codebook-sized sums are shuffled. All arithmetic is on exact integers: 64-bit ones
where no intermediate can exceed them, Python's for the rows and entries beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from monedero.llm.common import Scratch, tune

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: Rows that are assigned at once inside a task.
BLOCK = 2048
_LIMB = 60

#: Per vector length: [part][entry][component], Python integers.
Codebooks = dict[int, list[list[list[int]]]]


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds finite components only."""
    fine = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(F.col(vector).isNotNull() & fine)


def part_bounds(length: int, parts: int) -> list[int]:
    """Where the parts begin and end: equal widths where the length allows, else within one."""
    return [i * length // parts for i in range(parts + 1)]


def _integers(m: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) as whole floats, or as Python integers where a float overflows."""
    with np.errstate(over="ignore"):
        scaled = np.floor(m * factor)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([int(x) * factor if abs(x) > 1e300 else int(np.floor(x * factor)) for x in m.ravel()], object).reshape(m.shape)


def _python(m: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in m.ravel()], object).reshape(m.shape)


class Book:
    """The codebooks of one vector length, ready for assignment.

    With components of rows up to `small`, distances to entries up to `far` fit 64
    bits, and entries beyond `far` are farther than any entry up to `small`. So such
    rows are assigned in 64 bits wherever their part has an entry up to `small`.
    """

    def __init__(self, length: int, books: list[list[list[int]]]):
        self.parts = len(books)
        self.bounds = part_bounds(length, self.parts)
        self.width = np.diff(self.bounds)
        widest = max(1, int(self.width.max()))
        root = int(np.ceil(np.sqrt(widest)))
        self.small = max(0, int(2**29.5 / widest / (1 + root)) - 1)
        self.far = self.small * (1 + 2 * root) + 1
        near = [[i for i, e in enumerate(b) if all(abs(c) <= self.far for c in e)] for b in books]
        self.fast = all(any(all(abs(c) <= self.small for c in b[i]) for i in n) for b, n in zip(books, near, strict=True))
        self.exact = self._sorted(books, [list(range(len(b))) for b in books], widest, object)
        if self.fast:
            self.quick = self._sorted(books, near, widest, np.int64)

    def _sorted(self, books, chosen, widest, kind):
        most = max(map(len, chosen))
        sums = np.zeros((self.parts, most), kind)
        order = np.zeros((self.parts, most), np.int64)
        rows = np.zeros((self.parts, most, widest), kind)
        for p, (book, some) in enumerate(zip(books, chosen, strict=True)):
            some = sorted(some, key=lambda i: (sum(book[i]), i))
            for j, i in enumerate(some):
                sums[p, j], order[p, j] = sum(book[i]), i
                rows[p, j, : len(book[i])] = book[i]
        return sums, order, rows, np.array(list(map(len, chosen)))

    def assign(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every part of every row of whole numbers."""
        who = np.zeros((len(m), self.parts), np.int64)
        away = np.zeros((len(m), self.parts), object)
        small = np.zeros(len(m), bool)
        if self.fast and m.dtype != object:
            small = (np.abs(m) <= self.small).all(axis=1)
            who[small], away[small] = self._search(m[small].astype(np.int64), self.quick)
        if not small.all():
            who[~small], away[~small] = self._search(_python(m[~small]), self.exact)
        return who, away

    def _search(self, m: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
        sums, order, rows, count = tables
        x = np.zeros((len(m), self.parts, rows.shape[2]), m.dtype)
        for p, (a, b) in enumerate(zip(self.bounds, self.bounds[1:], strict=False)):
            x[:, p, : b - a] = m[:, a:b]
        own = x.sum(axis=2)
        right = np.stack([np.searchsorted(sums[p, : count[p]], own[:, p]) for p in range(self.parts)], axis=1).ravel()
        left = right - 1
        x, own = x.reshape(-1, rows.shape[2]), own.ravel()
        part = np.tile(np.arange(self.parts), len(m))
        last, width = count[part], np.maximum(self.width, 1)[part].astype(m.dtype)
        best = np.full(len(x), -1, m.dtype)
        who = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            p, lo, hi = part[live], left[live], right[live]
            below = own[live] - sums[p, np.maximum(lo, 0)]
            above = sums[p, np.minimum(hi, last[live] - 1)] - own[live]
            down = (lo >= 0) & ((hi >= last[live]) | (below <= above))
            gap = np.where(down, below, above)
            open_ = (lo >= 0) | (hi < last[live])
            within = (best[live] < 0) | (gap * gap <= best[live] * width[live])
            go = (open_ & within).astype(bool)
            live, p, down, lo, hi = live[go], p[go], down[go].astype(bool), lo[go], hi[go]
            at = np.where(down, lo, hi)
            delta = x[live] - rows[p, at]
            dist = (delta * delta).sum(axis=1)
            index = order[p, at]
            old = best[live]
            better = ((old < 0) | (dist < old) | ((dist == old) & (index < who[live]))).astype(bool)
            best[live[better]], who[live[better]] = dist[better], index[better]
            left[live] -= down
            right[live] += ~down
        return who.reshape(-1, self.parts), best.reshape(-1, self.parts)


def _matrices(column: pa.Array, factor: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of whole numbers) of a list column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, _integers(flat[starts[rows][:, None] + np.arange(d)], factor)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, small ones joined."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def first_entries(vectors: DataFrame, key: str, vector: str, *, parts: int, entries: int, factor: int) -> Codebooks:
    """Per vector length the parts of the rows with the smallest keys, nulls last."""
    size = F.size(vector)
    order = Window.partitionBy(size).orderBy(F.col(key).asc_nulls_last(), F.col(vector))
    rows = (
        vectors.select(F.row_number().over(order).alias("no"), F.col(vector).alias("v"))
        .where(F.col("no") <= entries)
        .orderBy("no")
        .collect()
    )
    books: Codebooks = {}
    for row in rows:
        m = _python(_integers(np.array([row.v], float).reshape(1, -1), factor))[0].tolist()
        bounds = part_bounds(len(m), parts)
        own = books.setdefault(len(m), [[] for _ in range(parts)])
        for p in range(parts):
            own[p].append(m[bounds[p] : bounds[p + 1]])
    return books


_SUM = pa.schema([(c, pa.int32()) for c in ("length", "part", "entry", "place", "limb")] + [("total", pa.int64())])


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(limb, number) with value = sum of number * 2^(60 * limb), each number a long."""
    no = 0
    while not -(1 << 62) <= value < 1 << 62:
        yield no, value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        no += 1
    yield no, value


def _sums(book: Book, length: int, m: np.ndarray, total: np.ndarray) -> None:
    """Add rows to `total` [part, entry, place], Python integers; the last place counts rows."""
    who, _ = book.assign(m)
    entries, wide = total.shape[1], total.shape[2] - 1
    for p, (a, b) in enumerate(zip(book.bounds, book.bounds[1:], strict=False)):
        at = who[:, p]
        total[p, :, wide] += np.bincount(at, minlength=entries).astype(object)
        part = m[:, a:b]
        plain = np.zeros(len(m), bool)
        if m.dtype != object and b > a:
            plain = (np.abs(part) < 2.0**36).all(axis=1)
            # A block has few rows, so these sums stay exact in floats.
            for c in range(b - a):
                own = np.bincount(at[plain], weights=part[plain, c], minlength=entries)
                total[p, :, c] += own.astype(np.int64).astype(object)
        for i in np.flatnonzero(~plain):
            total[p, at[i], : b - a] += _python(part[i])


def refine(vectors: DataFrame, vector: str, books: Codebooks, *, factor: int) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; unused ones stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, Book] = {}
        totals: dict[int, np.ndarray] = {}
        for b in _blocks(batches):
            for d, _, m in _matrices(b.column(0), factor):
                if d not in ready:
                    ready[d] = Book(d, shared.value[d])
                    wide = max(1, int(ready[d].width.max()))
                    totals[d] = np.zeros((ready[d].parts, len(shared.value[d][0]), wide + 1), object)
                _sums(ready[d], d, m, totals[d])
        for d, total in totals.items():
            out = [(d, *at, no, x) for at, v in np.ndenumerate(total) if total[at[0], at[1], -1] for no, x in _limbs(int(v))]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SUM, strict=True)], schema=_SUM
                )

    keys = ["length", "part", "entry", "place", "limb"]
    rows = (
        vectors.select(vector)
        .mapInArrow(add, "length int, part int, entry int, place int, limb int, total long")
        .groupBy(*keys)
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    shared.unpersist()
    found: dict[tuple, int] = {}
    for r in rows:
        at = (r.length, r.part, r.entry, r.place)
        found[at] = found.get(at, 0) + (int(r.total) << (_LIMB * r.limb))
    fresh: Codebooks = {}
    for d, parts in books.items():
        last = max(1, max(len(p[0]) for p in parts))
        fresh[d] = [
            [
                [found[d, p, e, c] // found[d, p, e, last] for c in range(len(entry))] if (d, p, e, last) in found else entry
                for e, entry in enumerate(book)
            ]
            for p, book in enumerate(parts)
        ]
    return fresh


def fit(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    factor: int = FACTOR,
) -> Codebooks:
    """Codebooks of all usable vectors; each vector length has its own.

    They start as the parts of the `entries` smallest keys (null keys last, equal
    keys by vector) and move to the floors of their parts' means in each round.
    Fewer rows make fewer entries; an empty table has no codebooks.
    """
    tune(vectors.sparkSession)
    rows = usable(vectors, vector)
    books = first_entries(rows, key, vector, parts=parts, entries=entries, factor=factor)
    for _ in range(rounds):
        books = refine(rows, vector, books, factor=factor)
    return books


def encode(
    vectors: DataFrame, books: Codebooks, *, vector: str = "embedding", columns=("vec_id",), factor: int = FACTOR
) -> DataFrame:
    """The given columns of every usable row with `code` and `error`.

    `code` holds the nearest entries in part order, two hex digits each; `error` is
    the sum of the squared distances, null where no long holds it. Ties go to the
    lower index. Rows of a length without codebooks are left out. Repeated rows get
    equal codes.
    """
    spark = tune(vectors.sparkSession)
    shared = spark.sparkContext.broadcast(books)
    rows = usable(vectors, vector).select(*columns, F.col(vector).alias("_code_vector"))
    width = len(rows.columns) - 1
    schema = rows.drop("_code_vector").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {d: Book(d, b) for d, b in shared.value.items()}
        for b in _blocks(batches):
            code, error = [None] * b.num_rows, [None] * b.num_rows
            for d, at, m in _matrices(b.column(width), factor):
                if d in ready:
                    who, away = ready[d].assign(m)
                    total = away.sum(axis=1)
                    for i, w, t in zip(at.tolist(), who.astype(np.uint8), total.tolist(), strict=True):
                        code[i], error[i] = w.tobytes().hex(), int(t) if t < 1 << 63 else None
            coded = [pa.array(code, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *coded], [*b.schema.names[:width], "code", "error"])

    return rows.mapInArrow(run, schema).where("code is not null")


def with_group_errors(coded: DataFrame, group: str, name: str, scratch: Scratch) -> DataFrame:
    """`coded` with the sum of `error` over the rows of equal `group`, nulls together.

    The sum is null where one of its errors is, or where no long holds it. Sums are
    taken in the tasks first, and one row per group is joined back.
    """
    rows = scratch.stage(coded)
    whole = F.count("error") == F.count(F.lit(1))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = rows.groupBy(F.col(group).alias("_group")).agg(F.when(whole, total.try_cast("long")).alias(name))
    return rows.join(totals, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def digest(books: Codebooks) -> str:
    """sha256 of all entries' decimal components by length, part, entry and place, comma-joined."""
    numbers = (str(c) for _, parts in sorted(books.items()) for book in parts for entry in book for c in entry)
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def oracle_sql() -> str:
    """The registered query for DuckDB: every distance computed, on vectors of one length."""

    def assign(no: int) -> str:
        away = "list_dot_product(s.v, s.v) - 2 * list_dot_product(s.v, c.v) + list_dot_product(c.v, c.v)"
        return f"""
a{no} AS MATERIALIZED (
  SELECT row, part, any_value(v) AS v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT s.row, s.part, s.v, c.entry, {away} AS d FROM s JOIN c{no} c ON c.part = s.part) GROUP BY row, part
)"""

    def move(no: int) -> str:
        return f"""
m{no} AS (
  SELECT part, entry, list(floor(total / n) ORDER BY place) AS v FROM (
    SELECT part, entry, place, sum(v[place]) AS total, count(*) AS n
    FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS place FROM a{no}) GROUP BY part, entry, place) GROUP BY part, entry
),
c{no + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{no} c LEFT JOIN m{no} m ON m.part = c.part AND m.entry = c.entry
)"""

    steps = [x for no in range(ROUNDS) for x in (assign(no), move(no))] + [assign(ROUNDS)]
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label,
    list_transform(embedding, lambda x: floor({FACTOR} * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS MATERIALIZED (
  SELECT row, p AS part, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] AS v FROM k, range({PARTS}) AS r(p)
),
c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM s WHERE row <= {ENTRIES}),{",".join(steps)},
h AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM c{ROUNDS})
),
e AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY row
),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM k JOIN e USING (row) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256
FROM k JOIN e USING (row) JOIN l ON l.label IS NOT DISTINCT FROM k.label, h
"""
