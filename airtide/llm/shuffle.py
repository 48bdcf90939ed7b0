"""Uniform shuffle of a table into shards of exact sizes, by a communication matrix.

Rows lie in parts: pieces of the input's partitions, of ``PART_ROWS`` rows at most. How many
rows each part sends to each shard is drawn first, from the law that a uniform permutation
gives these numbers: the multivariate hypergeometric one, with the parts' sizes as row sums
and the shards' sizes as column sums. The rows of a part are then permuted and cut into
stretches of the drawn lengths (the local permutation), sent to their shards (the exchange),
and permuted again there. So every order of all rows is as likely as any other, up to the
generator, and shards have their sizes exactly: they differ by one row at most.

The matrix is drawn in two levels, which changes nothing in its law: the driver draws it for
groups of parts (at most ``GROUP_CELLS`` cells or one group, however many parts there are),
and a task draws the rows of the parts of its group. A shard is permuted in buckets: each row
gets a bucket and a rank by hashes of its place and the seed, so that a shard of any size is
many tasks, and a running total over buckets gives the slots.

The places of rows are written to the shared folder before anything is drawn, and every draw
is seeded by the part or group it is for, so a task that runs again draws the same. The same
seed on other partitions of the same table gives another shuffle.

Edge cases: null, empty and repeated rows are rows like any other and keep their columns;
clashing names are no matter, but for ``shard`` and ``slot``, which are replaced. Fewer rows
than shards leave shards empty. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from airtide.llm.prefix_sums import with_offsets
from airtide.plans.staging import stage

SHARDS = 40
#: Rows of a part, which a task permutes in memory, as a power of two.
PART_BITS = 20
PART_ROWS = 1 << PART_BITS
#: Rows of a bucket of a shard, on average.
BUCKET_ROWS = 1 << 18
#: Cells of the driver's matrix, groups x shards.
GROUP_CELLS = 1 << 20
MOST_GROUPS = 1024

#: The library's own generator takes sums below this.
_LARGE = 10**9


def hypergeometric(random: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` rows, drawn without replacement, are among the ``good`` ones."""
    if max(good, bad) < _LARGE:
        return int(random.hypergeometric(good, bad, sample))
    lowest, highest = max(0, sample - bad), min(good, sample)
    total = good + bad
    mean = sample * (good / total)
    deviation = math.sqrt(max(mean * (bad / total) * ((total - sample) / max(1, total - 1)), 0.0))
    # Outside of these twelve deviations lies less than a double can tell from nothing.
    low = max(lowest, int(mean - 12 * deviation) - 60)
    high = min(highest, int(mean + 12 * deviation) + 60)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((sample - k) / (bad - sample + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    cumulative = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(cumulative, random.random() * cumulative[-1], side="right"))


def communication_matrix(
    random: np.random.Generator, rows: list[int], columns: list[int]
) -> np.ndarray:
    """Counts with the given row and column sums, as a uniform permutation would give them.

    The sums of ``rows`` and of ``columns`` are equal.
    """
    left = np.array(columns, np.int64)
    out = np.zeros((len(rows), len(left)), np.int64)
    for to, n in zip(out, rows):
        total = int(left.sum())
        if total < _LARGE:
            to[:] = random.multivariate_hypergeometric(left, n, method="marginals")
        else:
            for column, room in enumerate(left.tolist()):
                if not n:
                    break
                total -= room
                to[column] = hypergeometric(random, room, total, n)
                n -= int(to[column])
        left -= to
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    """The rows of each shard: equal, but for one more in the first ones."""
    return [n // shards + (i < n % shards) for i in range(shards)]


def _counts(parts: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """(part, counts per shard), and the number of rows."""
    groups = max(1, min(MOST_GROUPS, GROUP_CELLS // shards))
    grouped = parts.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int"))
    sizes = dict(grouped.groupBy("group").agg(F.sum("n")).collect())  # at most MOST_GROUPS rows
    n = sum(sizes.values())
    order = sorted(sizes)
    drawn = communication_matrix(
        np.random.default_rng([seed, 0]), [sizes[g] for g in order], shard_sizes(n, shards)
    )
    shared = parts.sparkSession.sparkContext.broadcast(dict(zip(order, drawn)))  # GROUP_CELLS numbers

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        random = np.random.default_rng([seed, 1, int(key[0])])
        counts = communication_matrix(random, rows["n"].tolist(), shared.value[key[0]].tolist())
        return pd.DataFrame({"part": rows["part"], "counts": list(counts)})

    return grouped.groupBy("group").applyInPandas(draw, "part long, counts array<long>"), n


def uniform_shuffle(docs: DataFrame, shards: int = SHARDS, *, seed: int = 0) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 in the shard) to every row."""
    if shards < 1:
        raise ValueError("a table goes into one shard or more")
    place = F.monotonically_increasing_id()
    rows = stage(docs.select(F.struct("*").alias("row"), place.alias("place")), "shuffle-rows")
    keys = rows.select(
        F.shiftright("place", PART_BITS).alias("part"),
        F.col("place").bitwiseAND(F.lit(PART_ROWS - 1)).alias("pos"),
    )
    parts = stage(keys.groupBy("part").agg(F.count("*").alias("n")), "shuffle-parts")
    counts, n = _counts(parts, shards, seed)

    def permute(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        part, counts = int(counts["part"].iloc[0]), counts["counts"].iloc[0]
        if len(rows) != counts.sum():
            raise RuntimeError(f"part {part} has {len(rows)} rows, not {counts.sum()}")
        order = np.random.default_rng([seed, 2, part]).permutation(len(rows))
        shard = np.repeat(np.arange(len(counts)), counts)[order]
        return pd.DataFrame({"part": part, "pos": rows["pos"], "shard": shard})

    sent = keys.groupBy("part").cogroup(counts.groupBy("part")).applyInPandas(
        permute, "part long, pos long, shard int"
    )
    buckets = -(-max(1, n // shards) // BUCKET_ROWS)
    sent = sent.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "part", "pos"), F.lit(buckets))
    )
    sent = stage(sent, "shuffle-sent")
    rank = Window.partitionBy("shard", "bucket").orderBy(
        F.xxhash64(F.lit(seed), F.lit("rank"), "part", "pos"), "part", "pos"
    )
    offsets = with_offsets(
        sent.groupBy("shard", "bucket").agg(F.count("*").alias("n")), ["shard"], "bucket", [], "n"
    ).select("shard", "bucket", "offset")
    placed = sent.withColumn("rank", F.row_number().over(rank)).join(offsets, ["shard", "bucket"])
    placed = placed.select(
        (F.shiftleft("part", PART_BITS) + F.col("pos")).alias("place"),
        "shard",
        (F.col("offset") + F.col("rank") - 1).alias("slot"),
    )
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return rows.join(placed, "place").select(*kept, "shard", "slot")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """A folder per shard, whose files hold its rows by slot."""
    ordered = shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def shuffle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return uniform_shuffle(rows).withColumn("grown_shard", F.lit(None).cast("int"))
