"""Near copies by SimHash: all pairs within a few bits, found with vantage-point trees.

Fingerprints that are equal are one point. The bits are cut into ``BANDS`` bands: two
points within ``max_bits`` are within ``max_bits // BANDS`` in at least one band, a
metric of its own. Every band has a vantage-point tree, built on the driver from a
bounded sample: each node holds a vantage point and a distance that divides its points
into near and far ones. Its leaves are shards. A point lives in one shard of each band
and visits all others that the triangle bound cannot exclude, those which its ball of
the band's radius may reach; visiting shards of higher number only, each pair meets once
per band. Within a shard the tree is grown on in numpy until few pairs are left, which
are compared in all 64 bits.

A shard returns links that span its groups, at most one per point and not its pairs, and
the groups are joined by ``components``. A shard of more than ``TASK_ROWS`` rows (a group
of near copies that no vantage point can divide) is dealt into tiles, and every two tiles
meet in a task: more work, but no lost pair and no unbounded task.

Edge cases: null and empty texts have fingerprint 0 and are linked like others. A null id
counts as larger than all others. Repeated rows are copies of each other. An empty table
has no rows. Other columns are carried along untouched by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from airtide.llm.components import star_links
from airtide.operators.lookup import attach
from airtide.plans.staging import stage

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BANDS = 3
#: Points of a shard, on average, and how many of them are sampled to find its borders.
SHARD_POINTS = 4096
SAMPLE_PER_SHARD = 32
MAX_SAMPLE = 1 << 18
#: Rows of a shard that one task takes.
TASK_ROWS = 1 << 17
#: Pairs that are compared at once.
PAIRS = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over word shingles, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - shingle] + 1])
    hashes = np.array(
        [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())],
        np.uint64,
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed long, and drop nothing."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return docs.withColumn("fp", fingerprints(F.coalesce(F.col(text).cast("string"), F.lit(""))))


class VantageTree:
    """A tree over the values of one band; its leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, radius: int, leaf_size: int, seed: int = 0):
        self.radius = radius
        self._random = np.random.default_rng(seed)
        self.leaves = 0
        self._root = self._grow(sample, leaf_size)

    def _grow(self, values: np.ndarray, leaf_size: int):
        split = best_split(values, self.radius, self._random) if len(values) > leaf_size else None
        if split is None:
            self.leaves += 1
            return self.leaves - 1
        vantage, border = split
        near = np.bitwise_count(values ^ vantage) <= border
        return vantage, border, self._grow(values[near], leaf_size), self._grow(values[~near], leaf_size)

    def shards(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, home) of every value's home and of the later shards it may reach."""
        found = []
        home = np.zeros(len(values), np.int64)
        todo = [(self._root, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, index, own = todo.pop()
            if not len(index):
                continue
            if isinstance(node, int):
                home[index[own]] = node
                found.append((index, np.full(len(index), node), own))
                continue
            vantage, border, near, far = node
            distance = np.bitwise_count(values[index] ^ vantage).astype(np.int64)
            reach = distance <= border + self.radius
            todo.append((near, index[reach], (own & (distance <= border))[reach]))
            reach = distance > border - self.radius
            todo.append((far, index[reach], (own & (distance > border))[reach]))
        if not found:
            return home, home, home.astype(bool)
        index, shard, own = (np.concatenate(part) for part in zip(*found))
        kept = own | (shard > home[index])
        return index[kept], shard[kept], own[kept]


def best_split(values: np.ndarray, radius: int, random) -> tuple | None:
    """The vantage point and border, of some tried, that leave the fewest pairs to compare."""
    best, chosen = 0.9, None
    for vantage in random.choice(values, min(6, len(values)), replace=False):
        counts = np.bincount(np.bitwise_count(values ^ vantage), minlength=65)
        up_to = np.concatenate([[0], np.cumsum(counts)]) / len(values)  # share with distance < i
        for border in range(0, 64):
            near = up_to[border + 1]
            if 0.02 < near < 0.98:
                reach_near = up_to[min(border + radius + 1, 65)]
                reach_far = 1 - up_to[max(border - radius + 1, 0)]
                pairs = near * reach_near + (1 - near) * reach_far
                if pairs < best:
                    best, chosen = pairs, (vantage, border)
    return chosen


class Groups:
    """Labels of points that links join; the smallest index of a group is its label."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label[:] = label[label]


def link_shard(points: np.ndarray, home: np.ndarray, band: np.ndarray, radius: int, max_bits: int):
    """Links (a, b), indexes into ``points``, that span all groups with a pair at home here."""
    groups = Groups(len(points))
    random = np.random.default_rng(0)
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, guests = todo.pop()
        if not len(own):
            continue
        everyone = np.concatenate([own, guests])
        split = None
        if len(own) * len(everyone) > PAIRS:
            split = best_split(band[own], radius, random)
        if split is None:
            step = max(1, PAIRS // len(everyone))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                differ = np.bitwise_count(points[some][:, None] ^ points[everyone][None, :])
                a, b = np.nonzero(differ <= max_bits)
                groups.join(some[a], everyone[b])
            continue
        vantage, border = split
        distance = np.bitwise_count(band ^ vantage).astype(np.int64)
        near = distance[own] <= border
        reach_near = guests[distance[guests] <= border + radius]
        far_guests = np.concatenate([guests, own[near]])
        reach_far = far_guests[distance[far_guests] > border - radius]
        todo += [(own[near], reach_near), (own[~near], reach_far)]
    joined = np.flatnonzero(groups.label != np.arange(len(points)))
    return joined, groups.label[joined]


def band_masks(bands: int) -> list[int]:
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def links_within(points: DataFrame, *, max_bits: int = MAX_BITS, bands: int = BANDS) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links (a, b) that span the groups of near ones."""
    radius = max_bits // bands
    masks = [np.uint64(m) for m in band_masks(bands)]
    n = points.count()
    n_shards = min(n // SHARD_POINTS, MAX_SAMPLE // SAMPLE_PER_SHARD)
    trees = [VantageTree(np.zeros(0, np.uint64), radius, 1)] * bands
    if n_shards > 1:
        share = n_shards * SAMPLE_PER_SHARD / n
        sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share * (1 << 30))
        sample = sample.limit(2 * MAX_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
        trees = [VantageTree(np.sort(sample) & m, radius, SAMPLE_PER_SHARD, i) for i, m in enumerate(masks)]
    shared = points.sparkSession.sparkContext.broadcast(trees)  # at most 2 * MAX_SAMPLE nodes a band

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            for i, (tree, mask) in enumerate(zip(shared.value, masks)):
                index, shard, home = tree.shards(fps.view(np.uint64) & mask)
                yield pd.DataFrame({"band": i, "shard": shard, "fp": fps[index], "home": home})

    routed = points.select("fp").mapInPandas(route, "band int, shard long, fp long, home boolean")
    large = routed.groupBy("band", "shard").count().where(F.col("count") > TASK_ROWS).collect()
    dealt = [(row["band"], row["shard"], -(-2 * row["count"] // TASK_ROWS)) for row in large]
    dealt = points.sparkSession.createDataFrame(dealt, "band int, shard long, tiles int")
    dealt = F.broadcast(dealt)  # at most a row per shard, MAX_SAMPLE / SAMPLE_PER_SHARD a band
    routed = routed.join(dealt, ["band", "shard"], "left").fillna(1, ["tiles"])
    routed = routed.withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    routed = routed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    routed = routed.select(
        "band", "shard", "fp", "home", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")
    )

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64)
        values = fps.view(np.uint64)
        mask = masks[int(rows["band"].iloc[0])]
        a, b = link_shard(values, rows["home"].to_numpy(bool), values & mask, radius, max_bits)
        return pd.DataFrame({"a": fps[a], "b": fps[b]})

    return routed.groupBy("band", "shard", "i", "j").applyInPandas(link, "a long, b long")


def near_copies(
    prints: DataFrame, *, max_bits: int = MAX_BITS, bands: int = BANDS
) -> DataFrame:
    """(key, id, fp) -> the same rows with ``component`` and the component's first row.

    ``key`` tells the rows apart. Rows are of one component if a chain of pairs within
    ``max_bits`` joins them. ``component`` is a fingerprint that stands for it;
    ``first_id`` and ``first_key`` are of its row with the smallest id, then key.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key"))
    points = stage(
        prints.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "simhash-points"
    )
    stars = star_links(links_within(points, max_bits=max_bits, bands=bands), "simhash-stars")
    points = points.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    points = points.select("fp", "first", "n", F.coalesce("root", "fp").alias("component"))
    firsts = points.groupBy("component").agg(
        F.min("first").alias("first"), F.count("*").alias("n_points")
    )
    found = attach(
        points.drop("first"), firsts, {"component": F.col("component")}, row_id="fp", weight="n_points"
    ).drop("n_points")
    found = found.select(
        "fp", "n", "component", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")
    )
    found = stage(found, "simhash-components")
    return attach(prints, found, {"fp": F.col("fp")}, row_id="key", weight="n").drop("n")


def deduplicate(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One document of each component: the one with the smallest id; columns as they were."""
    rows = docs.select(
        F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")
    )
    rows = stage(with_fingerprints(rows, f"row.`{text}`", shingle), "simhash-documents")
    prints = rows.select("key", F.col(f"row.`{id}`").alias("id"), "fp")
    kept = near_copies(prints, max_bits=max_bits).where("key = first_key").select("key")
    return rows.join(kept, "key", "left_semi").select("row.*")


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col("doc_id").alias("id"), "text"
    )
    prints = stage(with_fingerprints(prints, "text", SHINGLE).drop("text"), "simhash-fingerprints")
    return near_copies(prints).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first_id").alias("component_id"),
    )
