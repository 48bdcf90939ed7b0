"""The uniform shuffle: its laws, its sizes, and that no row is lost."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtide.llm import queries, shuffle

SMALL = "/root/testdata/sf0.001"


def chi_square(counts, expected):
    return sum((counts.get(k, 0) - e) ** 2 / e for k, e in expected.items())


def test_matrix_follows_the_law_of_permutations():
    rows, columns = [2, 3, 1], [3, 2, 1]
    owner = np.repeat([0, 1, 2], rows)
    law = Counter()
    for order in permutations(range(6)):
        matrix = np.zeros((3, 3), int)
        np.add.at(matrix, (owner[list(order)], np.repeat([0, 1, 2], columns)), 1)
        law[matrix.tobytes()] += 1 / math.factorial(6)
    random, n = np.random.default_rng(1), 20_000
    drawn = Counter(shuffle.communication_matrix(random, rows, columns).astype(int).tobytes() for _ in range(n))
    assert set(drawn) <= set(law)
    assert chi_square(drawn, {k: n * p for k, p in law.items()}) < len(law) + 5 * math.sqrt(2 * len(law))


def test_large_draws_follow_the_law(monkeypatch):
    monkeypatch.setattr(shuffle, "_LARGE", 0)  # the way of numbers that the generator refuses
    good, bad, sample, n = 9, 14, 11, 20_000
    law = {
        k: n * math.comb(good, k) * math.comb(bad, sample - k) / math.comb(good + bad, sample)
        for k in range(max(0, sample - bad), min(good, sample) + 1)
    }
    random = np.random.default_rng(2)
    drawn = Counter(shuffle.hypergeometric(random, good, bad, sample) for _ in range(n))
    assert set(drawn) <= set(law)
    assert chi_square(drawn, {k: e for k, e in law.items() if e > 5}) < 40
    assert [shuffle.hypergeometric(random, g, b, s) for g, b, s in ((5, 0, 3), (0, 5, 3), (4, 4, 8), (4, 4, 0))] == [3, 0, 4, 0]
    matrix = shuffle.communication_matrix(random, [5, 0, 7], [4, 4, 4])
    assert matrix.sum(axis=1).tolist() == [5, 0, 7] and matrix.sum(axis=0).tolist() == [4, 4, 4]


def test_draws_of_a_hundred_billion_rows():
    random = np.random.default_rng(3)
    n, shards = 10**11, 40
    drawn = np.array([shuffle.hypergeometric(random, n // shards, n - n // shards, 10**8) for _ in range(400)])
    deviation = math.sqrt(10**8 / shards * (1 - 1 / shards) * (1 - 1e-3))
    z = (drawn - 10**8 / shards) / deviation
    assert abs(z.mean()) < 0.25 and 0.85 < z.std() < 1.15 and abs(z).max() < 5
    matrix = shuffle.communication_matrix(random, [n // 2, n - n // 2], shuffle.shard_sizes(n, shards))
    assert matrix.sum() == n and matrix.min() > 0


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(shuffle, "PART_BITS", 3)
    monkeypatch.setattr(shuffle, "PART_ROWS", 8)
    monkeypatch.setattr(shuffle, "BUCKET_ROWS", 10)
    monkeypatch.setattr(shuffle, "MOST_GROUPS", 3)


@pytest.mark.parametrize("n, shards", [(0, 4), (3, 7), (100, 1), (211, 4)])
def test_exact_sizes_and_gapless_slots(spark, small_parts, n, shards):
    docs = spark.range(n).repartition(3).withColumns({"part": F.lit("own"), "slot": F.lit(-1), "bucket": F.lit(None)})
    out = shuffle.uniform_shuffle(docs, shards, seed=5).collect()
    assert sorted(r["id"] for r in out) == list(range(n))
    assert {r["part"] for r in out} <= {"own"} and {r["bucket"] for r in out} <= {None}
    for shard, size in enumerate(shuffle.shard_sizes(n, shards)):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(size))


def test_orders_are_uniform(spark, small_parts):
    """Places of each row, and of pairs of neighbours, over many seeds."""
    n, shards, seeds = 40, 4, 20
    docs = spark.range(n).coalesce(1)
    places, together = np.zeros((n, n), int), 0
    for seed in range(seeds):
        out = {r["id"]: 10 * r["shard"] + r["slot"] for r in shuffle.uniform_shuffle(docs, shards, seed=seed).collect()}
        assert sorted(out.values()) == list(range(n))
        places[list(out), list(out.values())] += 1
        together += sum(out[i] // 10 == out[i + 1] // 10 for i in range(n - 1))
    e = seeds / n
    assert abs(((places - e) ** 2 / e).sum() - (n - 1) ** 2) < 6 * math.sqrt(2) * (n - 1)
    p = 9 / 39
    assert abs(together / seeds - 39 * p) < 5 * math.sqrt(39 * p * (1 - p) / seeds) + 0.3


def test_the_same_seed_gives_the_same_shuffle(spark, odd_documents):
    docs = odd_documents.coalesce(1)
    one, other, third = (
        {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in shuffle.uniform_shuffle(docs, 3, seed=s).collect()}
        for s in (1, 1, 2)
    )
    assert one == other != third
    assert len(one) == docs.count()


def test_written_shards_hold_their_rows_by_slot(spark, tmp_path):
    shuffled = shuffle.uniform_shuffle(spark.range(100), 3)
    shuffle.write_shards(shuffled, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {tuple(r) for r in back.select("id", "shard", "slot").collect()} == {tuple(r) for r in shuffled.collect()}
    assert len(list((tmp_path / "shards").glob("shard=*"))) == 3


def test_shuffle_query(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.QUERIES["op12_shuffle"](spark, SMALL).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in out} == {
        (i, len(t) + 16, zlib.crc32(t)) for i, t in texts.items()
    }
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    sizes = shuffle.shard_sizes(len(texts), 40)
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, i) for s in range(40) for i in range(sizes[s])]


def test_null_and_empty_texts_have_a_size(spark, documents):
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents((1, None, None, None), (2, "", None, None)).withColumn("size", F.octet_length(text) + 16)
    assert {r["size"] for r in shuffle.uniform_shuffle(docs, 2).collect()} == {16}
