from __future__ import annotations

from pyspark.sql import functions as F

from airtide.operators import lookup, quality
from airtide.operators.quality import TableRule, constraint_report, upsert_by_key


def test_constraint_report(spark):
    keyed = spark.createDataFrame(
        [(1, "x"), (1, None), (2, None), (3, "y")], "id bigint, name string"
    )
    empty = keyed.limit(0)
    report = constraint_report(
        [
            (keyed, TableRule("t", ("id",), ("id", "name"))),
            (keyed, TableRule("pair", ("id", "name"))),
            (empty, TableRule("empty", ("id",))),
        ]
    )
    assert {tuple(r) for r in report.collect()} == {
        ("t", "id", 4, 1, 2), ("pair", "id,name", 4, 0, 2), ("empty", "id", 0, 0, 0),
    }


def test_rows_folded_into_cells_count_like_rows(spark):
    schema = "k string, cells array<struct<t:string,v:bigint>>"
    folded = spark.createDataFrame(
        [
            ("a", [("1", 1), ("2", 2), ("1", 3)]),
            ("b", [("1", 1), (None, None)]),
            ("b", [("2", 1), ("1", 9)]),
            (None, [("1", None)]),
            ("c", []),
        ],
        schema,
    )
    rule = TableRule("t", ("k", "t"), ("k", "t", "v"), cells="cells")
    rows = folded.select("k", F.inline("cells"))
    by_row = constraint_report([(rows, TableRule("t", ("k", "t"), ("k", "t", "v")))]).collect()
    assert constraint_report([(folded, rule)]).collect() == by_row
    assert tuple(by_row[0]) == ("t", "k,t", 8, 2, 4)


def test_hashes_that_meet_are_told_apart(spark, monkeypatch):
    """Every key hashes alike: the second phase counts whole keys."""
    monkeypatch.setattr(lookup, "HEAVY_ROWS", 50)
    monkeypatch.setattr(quality.F, "xxhash64", lambda *_: F.hash(F.lit(1)).cast("bigint"))
    keyed = spark.range(300).selectExpr("id % 200 AS id", "IF(id % 3 = 0, NULL, id) AS name")
    report = constraint_report([(keyed, TableRule("t", ("id",), ("id", "name")))]).first()
    assert tuple(report) == ("t", "id", 300, 100, 100)


def test_one_key_on_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY_ROWS", 50)
    keyed = spark.range(600).selectExpr("IF(id % 3 = 0, -1, id) AS id")
    report = constraint_report([(keyed, TableRule("t", ("id",)))]).first()
    assert tuple(report) == ("t", "id", 600, 199, 0)


def test_the_keys_of_sound_tables_are_not_shuffled(spark):
    """The first phase answers alone; its report holds no scan and no exchange."""
    keyed = spark.range(100).selectExpr("id", "string(id) AS name")
    report = constraint_report([(keyed, TableRule("t", ("id", "name")))])
    plan = report._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "100" in plan
    assert tuple(report.first()) == ("t", "id,name", 100, 0, 0)


def test_upsert(spark):
    schema = "k string, t string, v bigint"
    current = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), (None, "1", 3)], schema)
    changes = spark.createDataFrame([("a", "2", 20), ("b", "1", 30)], schema)
    got = upsert_by_key(current, changes.select("v", "t", "k"), ["k", "t"])
    assert sorted((r.k or "", r.t, r.v) for r in got.collect()) == [
        ("", "1", 3), ("a", "1", 1), ("a", "2", 20), ("b", "1", 30),
    ]


def test_the_last_of_several_changes_wins(spark):
    schema = "k string, v bigint, version int"
    current = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], schema)
    changes = spark.createDataFrame([("a", 10, 1), ("a", 12, 3), ("a", 11, 2), (None, 5, 1)], schema)
    got = upsert_by_key(current, changes, ["k"], order="version")
    assert sorted((r.k or "", r.v) for r in got.collect()) == [("", 5), ("a", 12), ("b", 2)]
