"""Product codes of vectors, with the nearest entries remembered by grid cells.

A vector becomes integers, floor(256 x), and is cut into parts of equal length. Each part
position has a codebook; a code names the nearest entry of each part. Codebooks are
learned by rounds: assign all parts, then move each entry to the floored mean of its parts.

To assign a part, its coarse grid cell is hashed and looked up in a memo. The memo holds,
for a cell, the entries that are not dominated across the cell's box: an entry is dropped
if its least distance to the box is more than the greatest distance of some other entry, so
that no point of the box can be nearest to it. Only the rest is evaluated, in exact
integers; an equal distance goes to the lower index. Points at equal least and greatest
distances stay in, so that ties come out as in a full comparison.

A task keeps a memo per codebook and starts it anew at ``MEMO_CELLS`` cells, so its memory
does not grow with the table. Two cells of one hash value are told apart: a row whose cell
is not the one remembered is compared with all entries. Tasks send sums and counts per
entry, and the driver gets one row per entry, parts x entries in all. The codebooks are
broadcast; with ``entries`` <= 256 their size is that of 256 vectors.

Edge cases: rows whose vector is null or holds null or non-finite components are dropped.
Vectors that are shorter than the longest, or whose length is no multiple of ``parts``,
count as padded with zeros. Components saturate at 2^24 in size (65,536 before scaling), so
that distances of up to 8,000 components fit a long. Of repeated ids the one with the
smaller vector comes first; null ids come last. Fewer rows than ``entries`` give shorter
codebooks. Repeated rows get a row each. An empty table gives no rows. Other columns than
those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from airtide.operators.lookup import attach
from airtide.plans.staging import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Side of a grid cell, in integer components.
CELL = 16
#: Cells that a task remembers at once, and (row, entry) pairs that it compares at once.
MEMO_CELLS = 1 << 18
PAIRS = 1 << 21
LARGEST = 1 << 24


def integer_vectors(table: DataFrame, id: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """(id, label, vector as array<long>) of the rows that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    values = F.transform(
        x, lambda v: F.floor(F.least(F.greatest(scale * v, F.lit(-float(LARGEST))), F.lit(float(LARGEST))))
    )
    return table.where(x.isNotNull() & finite).select(
        F.col(f"`{id}`").alias("id"),
        (F.col(f"`{label}`") if label else F.lit(None)).alias("label"),
        values.alias("vector"),
    )


def cell_hashes(cells: np.ndarray) -> np.ndarray:
    """A 64-bit hash per row of integer cell coordinates."""
    h = np.full(len(cells), 0x9E3779B97F4A7C15, np.uint64)
    for column in cells.T:
        h ^= column.astype(np.int64).view(np.uint64)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


class CellMemo:
    """Nearest entries of one codebook, through remembered candidates of grid cells."""

    def __init__(self, entries: np.ndarray, cell: int = CELL, limit: int = MEMO_CELLS):
        self.entries, self.cell, self.limit = entries, cell, limit
        self.evaluated = 0
        self._clear()

    def _clear(self) -> None:
        self._hashes = np.zeros(0, np.uint64)  # in order
        self._cells = np.zeros((0, self.entries.shape[1]), np.int64)
        self._candidates = np.zeros((0, len(self.entries)), bool)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """The entries that are not dominated across each cell's box, as flags."""
        out = np.zeros((len(cells), len(self.entries)), bool)
        step = max(1, PAIRS // max(1, self.entries.size))
        for at in range(0, len(cells), step):
            least = most = 0
            for low, entry in zip(cells[at : at + step].T[:, :, None] * self.cell, self.entries.T):
                below, beyond = low - entry, entry - low - (self.cell - 1)
                least = least + np.maximum(np.maximum(below, beyond), 0) ** 2
                most = most + np.maximum(-below, -beyond) ** 2
            out[at : at + step] = least <= most.min(axis=1, keepdims=True)
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each integer point."""
        cells = np.floor_divide(points, self.cell)
        hashes = cell_hashes(cells)
        distinct, first = np.unique(hashes, return_index=True)
        if len(self._hashes) + len(distinct) > self.limit:
            self._clear()
        at = np.searchsorted(self._hashes, distinct)
        known = at < len(self._hashes)
        known[known] = self._hashes[at[known]] == distinct[known]
        fresh = cells[first[~known]]
        if len(fresh):
            self._hashes = np.concatenate([self._hashes, distinct[~known]])
            order = np.argsort(self._hashes)
            self._hashes = self._hashes[order]
            self._cells = np.concatenate([self._cells, fresh])[order]
            self._candidates = np.concatenate([self._candidates, self.candidates(fresh)])[order]
        row_of = np.searchsorted(self._hashes, hashes)
        other = (self._cells[row_of] != cells).any(axis=1)  # another cell of the same hash
        index = np.zeros(len(points), np.int64)
        distance = np.zeros(len(points), np.int64)
        step = max(1, PAIRS // max(1, self.entries.size))
        for begin in range(0, len(points), step):
            some = slice(begin, begin + step)
            flags = self._candidates[row_of[some]]
            flags[other[some]] = True
            row, entry = np.nonzero(flags)
            self.evaluated += len(row)
            apart = np.zeros(len(row), np.int64)
            for x, e in zip(points[some].T, self.entries.T):
                apart += (x[row] - e[entry]) ** 2
            starts = np.searchsorted(row, np.arange(len(flags)))
            least = np.minimum.reduceat(apart, starts) if len(row) else apart
            hit = np.flatnonzero(apart == least[row])
            _, lowest = np.unique(row[hit], return_index=True)
            index[some] = entry[hit[lowest]]
            distance[some] = least
        return index, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array<long> column without nulls as a matrix, padded with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _memos(books: np.ndarray, cell: int) -> list[CellMemo]:
    return [CellMemo(book, cell) for book in books]


def _rounded(width: int, parts: int) -> int:
    return -(-max(width, 1) // parts) * parts


def train(
    vectors: DataFrame,
    *,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    cell: int = CELL,
) -> np.ndarray:
    """Codebooks (part, entry, component) of ``integer_vectors``, read once per round and once before."""
    if not 1 <= entries <= 256:
        raise ValueError("a code holds two hex digits per part: 1 to 256 entries")
    width = _rounded(vectors.agg(F.max(F.size("vector"))).first()[0] or 1, parts)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = np.zeros((len(first), width), np.int64)
    for to, row in zip(start, first):
        to[: len(row["vector"])] = row["vector"]
    books = start.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    schema = "part int, entry int, n long, sums array<long>"
    for _ in range(rounds if len(first) else 0):
        shared = vectors.sparkSession.sparkContext.broadcast(books)  # at most 256 vectors

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            memos = _memos(books, cell)
            counts = np.zeros(books.shape[:2], np.int64)
            sums = np.zeros(books.shape, np.int64)
            for batch in batches:
                matrix = _matrix(batch.column(0), width).reshape(len(batch), parts, -1)
                for part, memo in enumerate(memos):
                    index, _ = memo.nearest(matrix[:, part])
                    counts[part] += np.bincount(index, minlength=len(books[part]))
                    np.add.at(sums[part], index, matrix[:, part])
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()),
                    pa.array(entry, pa.int32()),
                    pa.array(counts[part, entry]),
                    pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
                ],
                ["part", "entry", "n", "sums"],
            )

        found = vectors.select("vector").mapInArrow(assign, schema)
        each = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width // parts)]
        means = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect()  # parts x entries
        books = books.copy()
        for row in means:
            books[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width // parts)]
    return books


def encode(vectors: DataFrame, books: np.ndarray, *, cell: int = CELL) -> DataFrame:
    """(id, label, code, error): the nearest entries as hex digits, and their squared distances' sum."""
    parts, _, part_width = books.shape
    width = parts * part_width
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    digits = [f"{i:02x}" for i in range(256)]
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("id", "label"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = _memos(shared.value, cell)
        for batch in batches:
            matrix = _matrix(batch.column(2), width).reshape(len(batch), parts, -1)
            codes = np.zeros((len(batch), parts), np.int64)
            error = np.zeros(len(batch), np.int64)
            for part, memo in enumerate(memos):
                codes[:, part], distance = memo.nearest(matrix[:, part])
                error += distance
            code = ["".join([digits[i] for i in row]) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)],
                ["id", "label", "code", "error"],
            )

    return vectors.select("id", "label", "vector").mapInArrow(
        assign, f"id {id_type}, label {label_type}, code string, error long"
    )


def decode(codes: DataFrame, books: np.ndarray, *, code: str = "code") -> DataFrame:
    """Add ``vector``, the entries that the code names, one after another; null for a null code."""
    parts, _, _ = books.shape
    shared = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf("array<long>")
    def entries(values):
        def one(value):
            indexes = bytes.fromhex(value)
            return np.concatenate([shared.value[part, i] for part, i in zip(range(parts), indexes)])

        return values.map(one, na_action="ignore")

    return codes.withColumn("vector", entries(F.col(f"`{code}`")))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def label_errors(codes: DataFrame) -> DataFrame:
    """Add ``label_error``, the sum of ``error`` over the rows of the same label; nulls are one label.

    A label may hold any share of the rows: sums are made before the shuffle, and rows get
    them by ``attach``.
    """
    key = {"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}
    totals = codes.groupBy(*[value.alias(name) for name, value in key.items()]).agg(
        F.sum("error").alias("label_error"), F.count("*").alias("_rows")
    )
    rows = codes.withColumn("_row", F.monotonically_increasing_id())
    return attach(rows, totals, key, row_id="_row", weight="_rows").drop("_row", "_rows")


def codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = integer_vectors(table, "vec_id", "embedding", "label", SCALE)
    books = train(vectors)
    codes = stage(encode(vectors, books), "vector-codes")
    return label_errors(codes).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"),
    )


_ROUND = """
, near{n} AS (
    SELECT id, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
    FROM (
        SELECT p.id, p.part, p.x, b.entry,
            list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, b.x)])::BIGINT AS d
        FROM parts p JOIN book{n} b ON p.part = b.part
    ) GROUP BY id, part, x
)"""

_MEANS = """
, means{n} AS (
    SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY i) AS x
    FROM (
        SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS c
        FROM near{n}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM parts))) AS i)
        GROUP BY part, entry, i
    ) GROUP BY part, entry
)
, book{m} AS (
    SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
    FROM book{n} b LEFT JOIN means{n} m ON b.part = m.part AND b.entry = m.entry
)"""

#: For tables whose ids and vectors are distinct and of one length.
CODES_SQL = (
    f"""
WITH vectors AS MATERIALIZED (
    SELECT vec_id AS id, label, [floor({SCALE} * v::DOUBLE)::BIGINT for v in embedding] AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0
)
, parts AS MATERIALIZED (
    SELECT id, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] AS x
    FROM vectors, (SELECT unnest(range({PARTS})) AS part)
)
, book0 AS (
    SELECT part, (row_number() OVER (PARTITION BY part ORDER BY id)) - 1 AS entry, x
    FROM parts WHERE id IN (SELECT id FROM vectors ORDER BY id LIMIT {ENTRIES})
)"""
    + "".join(_ROUND.format(n=n) + _MEANS.format(n=n, m=n + 1) for n in range(ROUNDS))
    + _ROUND.format(n=ROUNDS)
    + f"""
, codes AS (
    SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
    FROM near{ROUNDS} GROUP BY id
)
SELECT v.id AS vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY v.label))::BIGINT AS label_error,
    (
        SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}
    ) AS codebooks_sha256
FROM vectors v JOIN codes c ON v.id = c.id
"""
)
