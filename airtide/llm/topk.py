"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers, floor(64 x), and lie in blocks of consecutive ids. A block
keeps its vectors as a forward index and, for every component (term), the largest and
smallest value in it. For a query, the sum over its terms of weight times the largest
value (the smallest, for negative weights) bounds every score in a block. Blocks are
visited in the order of that bound, scored in full through their forward index, and the
search ends at the first block whose bound is below the k-th best score so far.

Blocks lie in ranges of ids and queries in batches; a task searches one range for one
batch, so the table is met by the queries in blocks and neither is collected. Ranges are
taken in waves of doubling size, and a wave starts from the k-th scores of all earlier
ones: a range then reports the few rows that beat them, not k rows for each query. The
maxima and minima alone are sent to every batch; a block's vectors only go to the batches
in which some query's bound reaches its k-th score. The state between waves (k rows per query) is written to the shared folder.

Edge cases: vectors that are null, or hold null or non-finite components, take no part,
nor do rows with a null id. Shorter vectors count as padded with zeros. A query's own
rows are all that have its id; a repeated query row gets its result again. Equal scores
go by id. Fewer than k candidates give fewer rows. Scores must fit a long. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from airtide.plans.staging import stage

K = 20
SCALE = 64
BLOCK_ROWS = 256
RANGE_ROWS = 8192
BATCH_QUERIES = 1024

#: Stands for no score; its negative is a long too.
LOWEST = -(2**63) + 1

_VECTORS = "range long, block long, width long, ids binary, vectors binary, largest binary, smallest binary"


def integer_vectors(table: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """(id, vector as array<long>) of the rows that take part."""
    x = F.col(f"`{vector}`")
    finite = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    )
    values = F.transform(x, lambda v: F.floor(scale * v.cast("double")))
    taking_part = F.col(f"`{id}`").isNotNull() & x.isNotNull() & finite
    return table.where(taking_part).select(
        F.col(f"`{id}`").cast("long").alias("id"), values.alias("vector")
    )


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for to, row in zip(out, rows):
        to[: len(row)] = row
    return out


def _blocks(vectors: DataFrame, range_rows: int, block_rows: int) -> DataFrame:
    """The forward index: a row per block, with term maxima and minima."""
    ranges = max(1, -(-vectors.count() // range_rows))
    ordered = vectors.repartitionByRange(ranges, "id").sortWithinPartitions("id")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for at in range(0, len(batch), block_rows):
                part = batch.iloc[at : at + block_rows]
                matrix = _matrix([*part["vector"]])
                rows.append(
                    (
                        number,
                        block,
                        matrix.shape[1],
                        part["id"].to_numpy(np.int64).tobytes(),
                        matrix.tobytes(),
                        matrix.max(axis=0).tobytes(),
                        matrix.min(axis=0).tobytes(),
                    )
                )
                block += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _VECTORS.split(", ")])

    return stage(ordered.mapInPandas(build, _VECTORS), "topk-blocks")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers; by floating point where that is exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _pad(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def search_blocks(queries, query_ids, floors, blocks, k: int):
    """The rows of ``blocks`` that may be among a query's k best: (query, id, score) arrays.

    ``floors`` are scores that a row must reach; ``blocks`` are (ids, vectors, largest,
    smallest). For each query at most k rows come back.
    """
    width = max([queries.shape[1], *(b[1].shape[1] for b in blocks)])
    queries = _pad(queries, width)
    largest = _pad(np.array([_pad(b[2][None], width)[0] for b in blocks]), width)
    smallest = _pad(np.array([_pad(b[3][None], width)[0] for b in blocks]), width)
    bounds = _bounds(queries, largest, smallest)
    order = np.argsort(-bounds, axis=1, kind="stable")
    none = LOWEST
    scores = np.full((len(queries), k), none)
    ids = np.zeros((len(queries), k), np.int64)
    floors = floors.copy()
    active = np.arange(len(queries))
    for turn in range(len(blocks)):
        block_of = order[active, turn]
        alive = bounds[active, block_of] >= floors[active]
        active, block_of = active[alive], block_of[alive]
        for b in np.unique(block_of):
            some = active[block_of == b]
            block_ids, vectors = blocks[b][:2]
            found = _product(queries[some], _pad(vectors, width))
            found[block_ids[None, :] == query_ids[some][:, None]] = none
            found[found < floors[some][:, None]] = none
            all_scores = np.hstack([scores[some], found])
            all_ids = np.hstack([ids[some], np.broadcast_to(block_ids, found.shape)])
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[some] = np.take_along_axis(all_scores, best, 1)
            ids[some] = np.take_along_axis(all_ids, best, 1)
            floors[some] = np.maximum(floors[some], scores[some][:, k - 1])
    query, place = np.nonzero(scores != none)
    return query, ids[query, place], scores[query, place]


def top_k(
    table: DataFrame,
    queries: Column,
    *,
    id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    range_rows: int = RANGE_ROWS,
    block_rows: int = BLOCK_ROWS,
    batch_queries: int = BATCH_QUERIES,
) -> DataFrame:
    """The k rows with the highest inner product, for each row where ``queries`` holds.

    ``queries`` is a condition on the column ``id``. Columns: query_id, rank (from 1),
    vec_id, score.
    """
    vectors = integer_vectors(table, id, vector, scale)
    blocks = _blocks(vectors, range_rows, block_rows)
    last = blocks.agg(F.max("range")).first()[0]
    asked = vectors.where(queries).withColumn("key", F.monotonically_increasing_id())
    asked = stage(asked, "topk-queries")
    batches = max(1, -(-asked.count() // batch_queries))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches).cast("long")))
    best = asked.sparkSession.createDataFrame([], "key long, id long, score long")
    start, size = 0, 1
    while last is not None and start <= last:
        end = min(last, start + size - 1)
        best = stage(_wave(asked, blocks, best, start, end, batches, k), "topk-best")
        start, size = end + 1, end + 1
    named = best.join(asked.select("key", F.col("id").alias("query_id")), "key")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return named.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score")


def _asked_with_floors(asked: DataFrame, best: DataFrame, start: int, end: int, k: int) -> DataFrame:
    """The queries with their k-th scores so far, for each of the ranges."""
    floors = best.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    floors = floors.where(F.col("n") == k).select("key", "floor")
    ranges = F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long")))
    return asked.join(floors, "key", "left").withColumn("range", ranges)


def _floors(queries: pd.DataFrame) -> np.ndarray:
    return np.array([LOWEST if pd.isna(f) else int(f) for f in queries["floor"].to_numpy(object)], np.int64)


def _bounds(queries: np.ndarray, largest: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """The highest score that a row of each block can have with each query."""
    return _product(np.maximum(queries, 0), largest) + _product(np.minimum(queries, 0), smallest)


def _surviving(here: DataFrame, blocks: DataFrame, start: int, end: int, batches: int) -> DataFrame:
    """(range, block, batch) where the block may hold a row for a query of the batch."""
    extremes = blocks.where(F.col("range").between(start, end)).select(
        "range", "block", "largest", "smallest",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))).alias("batch"),
    )

    def reach(queries: pd.DataFrame, extremes: pd.DataFrame) -> pd.DataFrame:
        names = ["range", "block", "batch"]
        if not len(queries) or not len(extremes):
            return pd.DataFrame({name: [] for name in names}, dtype=np.int64)
        asked = _matrix([*queries["vector"]])
        ends = [_matrix([np.frombuffer(b, np.int64) for b in extremes[c]]) for c in ("largest", "smallest")]
        width = max(asked.shape[1], ends[0].shape[1])
        bounds = _bounds(_pad(asked, width), *(_pad(e, width) for e in ends))
        return extremes.loc[(bounds >= _floors(queries)[:, None]).any(axis=0), names]

    return (
        here.groupBy("range", "batch")
        .cogroup(extremes.groupBy("range", "batch"))
        .applyInPandas(reach, "range long, block long, batch long")
    )


def _wave(asked, blocks, best, start: int, end: int, batches: int, k: int) -> DataFrame:
    """``best`` after ranges start..end: at most k rows for each query."""
    here = _asked_with_floors(asked, best, start, end, k)
    met = blocks.where(F.col("range").between(start, end)).join(
        _surviving(here, blocks, start, end, batches), ["range", "block"]
    )

    def search(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(blocks):
            return pd.DataFrame({"key": [], "id": [], "score": []}, dtype=np.int64)
        forward = [
            (
                np.frombuffer(b.ids, np.int64),
                np.frombuffer(b.vectors, np.int64).reshape(-1, b.width),
                np.frombuffer(b.largest, np.int64),
                np.frombuffer(b.smallest, np.int64),
            )
            for b in blocks.itertuples()
            if b.width or len(b.ids)
        ]
        query, ids, scores = search_blocks(
            _matrix([*queries["vector"]]), queries["id"].to_numpy(np.int64), _floors(queries), forward, k
        )
        return pd.DataFrame({"key": queries["key"].to_numpy()[query], "id": ids, "score": scores})

    found = (
        here.groupBy("range", "batch")
        .cogroup(met.groupBy("range", "batch"))
        .applyInPandas(search, "key long, id long, score long")
    )
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    return best.union(found).withColumn("place", place).where(F.col("place") <= k).drop("place")


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, F.col("id") % 20 == 0)


TOPK_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e AS q JOIN e AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
