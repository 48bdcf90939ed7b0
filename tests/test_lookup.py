from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from airtide.operators import lookup


@pytest.mark.parametrize("heavy_rows", [1, 10, 50, 1000])
@pytest.mark.parametrize("weighted", [True, False])
def test_attach_is_a_left_join(spark, monkeypatch, heavy_rows, weighted):
    monkeypatch.setattr(lookup, "HEAVY_ROWS", heavy_rows)
    random.seed(heavy_rows)
    facts = [(i, random.choice(["a"] * 20 + ["b", "c", "d", "e", "x", None])) for i in range(300)]
    table = [("a", 1.0), ("b", 2.0), ("c", None), ("d", 4.0), ("e", 5.0), ("unused", 6.0)]
    counts = {k: sum(f[1] == k for f in facts) for k, _ in table}
    fact_df = spark.createDataFrame(facts, "id bigint, key string").repartition(5)
    table_df = spark.createDataFrame(
        [(k, v, counts[k]) for k, v in table], "name string, value double, n bigint"
    )
    if not weighted:
        table_df = table_df.drop("n")
    got = lookup.attach(
        fact_df,
        table_df,
        {"name": F.col("key")},
        weight="n" if weighted else None,
        matched="known",
    )
    known = dict(table)
    want = sorted((i, k or "", known.get(k) or -1.0, k in known) for i, k in facts)
    rows = sorted((r.id, r.key or "", r.value or -1.0, r.known) for r in got.collect())
    assert rows == want


def test_attach_two_keys_and_skipped_rows(spark):
    facts = spark.createDataFrame(
        [(1, "d1", 5), (2, "d1", 0), (3, "d2", 5), (4, "d1", None)],
        "id bigint, date string, number bigint",
    )
    table = spark.createDataFrame(
        [("d1", 5, 10), ("d1", 0, 99)], "date string, number bigint, mean bigint"
    )
    number = F.col("number")
    got = lookup.attach(
        facts, table, {"date": F.col("date"), "number": F.when(number != 0, number)}
    )
    assert {r.id: r.mean for r in got.collect()} == {1: 10, 2: None, 3: None, 4: None}


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("weighted", [True, False])
def test_rows_of_a_heavy_key_are_spread(spark, monkeypatch, known, weighted):
    """The rows of a heavy key go to all tasks, also if the table lacks the key."""
    if weighted and not known:
        pytest.skip("a table with row counts has every heavy key")
    monkeypatch.setattr(lookup, "HEAVY_ROWS", 1000)
    facts = spark.range(2000).select("id", F.lit("hot").alias("key"))
    table = spark.createDataFrame(
        [("hot" if known else "cold", 1, 2000)], "name string, value int, n bigint"
    )
    off = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        joined = lookup.attach(
            facts,
            table,
            {"name": F.col("key")},
            weight="n" if weighted else None,
            matched="hit",
        )
        sizes = joined.groupBy(F.spark_partition_id(), "hit").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.hit for r in sizes} == {known}
    assert sum(r["count"] for r in sizes) == 2000
    assert max(r["count"] for r in sizes) < 2000 / 4


def test_no_number_of_heavy_keys_is_too_large(spark, monkeypatch):
    """5,000 equal keys, all heavy: no task gets over twice the median."""
    monkeypatch.setattr(lookup, "HEAVY_ROWS", 4)
    facts = spark.range(20_000).select("id", (F.col("id") % 5000).alias("key"))
    table = spark.range(5000).select(F.col("id").alias("name"), F.lit(1).alias("value"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        joined = lookup.attach(facts, table, {"name": F.col("key")})
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        found = joined.where("value = 1").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == sum(sizes) == 20_000
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
