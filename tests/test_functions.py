from __future__ import annotations

import math

from pyspark.sql import functions as F

from airtide.functions import numeric, slots


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_slot_start(spark):
    times = ["00:00:00", "09:14:59", "09:15:00", "23:59:59", "9:5:7"]
    rows = spark.createDataFrame([(t,) for t in times], "t string")
    got = [r.s for r in rows.select(slots.slot_start(F.col("t")).alias("s")).collect()]
    assert got == ["00:00", "09:00", "09:15", "23:45", "09:00"]


def test_slot_tables_agree(spark):
    labels = slots.slot_labels()
    assert len(labels) == 96 and labels[0] == "00:00" and labels[-1] == "23:45"
    assert [r.time for r in slots.time_slots(spark).collect()] == labels
    assert value(spark, slots.slot_label_array()) == labels
    from_noon = slots.slot_labels_from_noon()
    assert from_noon[0] == "12:00" and from_noon[-1] == "11:45"
    rows = spark.createDataFrame([(t,) for t in labels], "time string")
    key = slots.minutes_from_noon_order(F.col("time"))
    assert [r.time for r in rows.orderBy(key).collect()] == from_noon


def test_hour_order_and_flags(spark):
    def of(time, expression):
        return value(spark, expression(F.lit(time)))

    assert of("12:15", slots.hour_from_noon_order) == 12
    assert of("11:45", slots.hour_from_noon_order) == 35
    evening = {t: of(t, slots.in_evening) for t in ("17:45", "18:00", "04:45", "05:00")}
    assert evening == {"17:45": False, "18:00": True, "04:45": True, "05:00": False}
    assert of("07:00", slots.is_whole_hour) and not of("07:15", slots.is_whole_hour)


def test_minute_number_round_trip(spark):
    for date, time in [("2024-02-29", "23:45"), ("1970-01-01", "00:00"), ("1969-12-31", "00:15")]:
        number = slots.minute_number(F.lit(date), F.lit(time))
        assert value(spark, slots.minute_text(number)) == f"{date} {time}"


def test_binary_half_even_is_the_exact_rounding(spark):
    pairs = [(s, d) for d in (1, 3, 4, 8, 20, 40, 60) for s in range(0, 700, 3)]
    rows = spark.createDataFrame(pairs, "s bigint, d bigint").select(
        "s",
        "d",
        numeric.round_binary_half_even(F.col("s") / F.col("d"), 1).alias("r"),
    )
    for r in rows.collect():
        assert r.r == round(r.s / r.d, 1), (r.s, r.d)
    assert value(spark, numeric.round_binary_half_even(F.lit(1234567.25), 1)) == 1234567.2


def test_round_is_half_away_from_zero(spark):
    for x, digits, want in [(2.675, 2, 2.68), (1.005, 2, 1.01), (-0.125, 2, -0.13)]:
        assert value(spark, F.round(F.lit(x), digits)) == want


def test_log_helpers(spark):
    assert value(spark, numeric.positive_ln(F.lit(0))) is None
    assert value(spark, numeric.log_growth(F.lit(-100.0))) is None
    assert value(spark, numeric.log_growth_or_zero(F.lit(-100.0))) == 0.0
    assert value(spark, numeric.log_growth_or_zero(F.lit(-250.0))) == 0.0
    assert math.isclose(value(spark, numeric.log_growth_or_zero(F.lit(50.0))), math.log(1.5))


def test_weighted_mean_of_rounded_on_a_tie(spark):
    # (0.01 + 0.02) / 2 = 0.015 exactly, which half away from zero takes to 0.02
    mean = numeric.weighted_mean_of_rounded(F.lit(3), F.lit(2), 100, 2)
    assert value(spark, mean) == 0.02
    negative = numeric.weighted_mean_of_rounded(F.lit(-3), F.lit(2), 100, 2)
    assert value(spark, negative) == -0.02
    tenths = numeric.weighted_mean_of_rounded(F.lit(25), F.lit(4), 10, 2)
    assert value(spark, tenths) == 0.63
    assert value(spark, numeric.weighted_mean_of_rounded(F.lit(0), F.lit(0), 100, 2)) is None
