"""Per-channel baselines: statistics of the fact, joined to the channel table.

The statistics come from one aggregation of the fact, or from states of days that are
kept, so that a new day reads no history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airtide.functions.numeric import positive_ln
from airtide.settings import PLATFORMS


def channel_statistics(facts: DataFrame) -> DataFrame:
    """Unrounded mean and population deviation per channel, raw and in ln space."""
    measures: list[Column] = []
    for p in PLATFORMS:
        viewers = F.when(F.col(p.number) != 0, F.col(p.viewers))
        measures += [
            F.avg(viewers).alias(f"{p.prefix}_mean"),
            F.stddev_pop(viewers).alias(f"{p.prefix}_sigma"),
            F.avg(positive_ln(viewers)).alias(f"{p.prefix}_ln_mean"),
            F.stddev_pop(positive_ln(viewers)).alias(f"{p.prefix}_ln_sigma"),
        ]
    return facts.groupBy(F.col("channel").alias("channel_id")).agg(*measures)


def channel_days(facts: DataFrame) -> DataFrame:
    """State of each day and channel, from which statistics over any days follow.

    Count, sum and sum of squared deviations, raw and in ln space: unlike plain sums of
    squares, deviations keep their precision when days are merged.
    """
    state: list[Column] = []
    for p in PLATFORMS:
        viewers = F.when(F.col(p.number) != 0, F.col(p.viewers))
        summed = {p.prefix: viewers.cast("decimal(19, 0)"), f"{p.prefix}_ln": positive_ln(viewers)}
        for name, value in summed.items():
            state += [
                F.count(value).alias(f"{name}_n"),
                F.sum(value).alias(f"{name}_total"),
                (F.var_pop(value) * F.count(value)).alias(f"{name}_squares"),
            ]
    return facts.groupBy("date", F.col("channel").alias("channel_id")).agg(*state)


def merged_statistics(days: DataFrame) -> DataFrame:
    """``channel_statistics`` of all facts, from the states of their days.

    Deviations of days are moved to the channel's own mean, which is taken first; a
    channel has a row per day, so both aggregations are small.
    """
    names = [f"{p.prefix}{kind}" for p in PLATFORMS for kind in ("", "_ln")]

    def mean(total: str, n: str) -> Column:
        return F.try_divide(F.col(total).cast("double"), F.col(n).cast("double"))

    means = days.groupBy("channel_id").agg(
        *[F.sum(f"{c}_{kind}").alias(f"_{c}_{kind}") for c in names for kind in ("n", "total")]
    )
    means = means.select(
        "channel_id", *[mean(f"_{c}_total", f"_{c}_n").alias(f"_{c}_mean") for c in names]
    )

    def squares(c: str) -> Column:
        apart = mean(f"{c}_total", f"{c}_n") - F.col(f"_{c}_mean")
        return F.col(f"{c}_squares") + F.col(f"{c}_n") * apart * apart

    around = days.join(means, "channel_id").groupBy("channel_id").agg(
        *[F.first(f"_{c}_mean").alias(f"{c}_mean") for c in names],
        *[F.try_divide(F.sum(squares(c)), F.sum(f"{c}_n")).alias(f"_{c}_variance") for c in names],
    )
    return around.select(
        "channel_id",
        *[f"{c}_mean" for c in names],
        *[F.sqrt(f"_{c}_variance").alias(f"{c}_sigma") for c in names],
    )


def _per_streamer(statistics: DataFrame, streamers: DataFrame, columns) -> DataFrame:
    """All streamers, also silent ones, with ``columns(prefix)`` of both platforms."""
    joined = streamers.select("channel_id", "channel_name").join(statistics, "channel_id", "left")
    return joined.select(
        "channel_id", "channel_name", *[c for p in PLATFORMS for c in columns(p.prefix)]
    )


def _mean_and_deviation(p: str) -> list[Column]:
    return [
        F.coalesce(F.round(f"{p}_mean", 1), F.lit(0.0)).alias(f"{p}_avg"),
        F.coalesce(F.round(f"{p}_sigma", 1), F.lit(0.0)).alias(f"{p}_std"),
    ]


def channel_baseline(facts: DataFrame, streamers: DataFrame, z: float = 2.5) -> DataFrame:
    return baseline_with_band(channel_statistics(facts), streamers, z)


def channel_baseline_clean(facts: DataFrame, streamers: DataFrame) -> DataFrame:
    return baseline_clean(channel_statistics(facts), streamers)


def channel_baseline_geo(facts: DataFrame, streamers: DataFrame) -> DataFrame:
    return baseline_geo(channel_statistics(facts), streamers)


def baseline_with_band(statistics: DataFrame, streamers: DataFrame, z: float = 2.5) -> DataFrame:
    """Baseline for outlier cuts; NULL for silent channels.

    ``{p}_min`` and ``{p}_max`` are no extremes: they are the band
    ``exp(mean -/+ z * deviation)`` in ln space, back in viewers.
    """

    def columns(p: str) -> list[Column]:
        mean, sigma = F.col(f"{p}_ln_mean"), F.col(f"{p}_ln_sigma")
        return [
            F.round(f"{p}_mean", 1).alias(f"{p}_avg"),
            F.round(f"{p}_sigma", 1).alias(f"{p}_std"),
            F.round(mean, 3).alias(f"{p}_ln_avg"),
            F.round(sigma, 3).alias(f"{p}_ln_std"),
            F.round(F.exp(mean - z * sigma), 1).alias(f"{p}_min"),
            F.round(F.exp(mean + z * sigma), 1).alias(f"{p}_max"),
        ]

    return _per_streamer(statistics, streamers, columns)


def baseline_clean(statistics: DataFrame, streamers: DataFrame) -> DataFrame:
    """Baseline after the two-sided cut; 0 for silent channels, NULL log mean.

    ``{p}_geo_avg`` is the geometric mean and ``{p}_log_geo_avg`` its ln.
    """

    def columns(p: str) -> list[Column]:
        mean = F.col(f"{p}_ln_mean")
        return [
            *_mean_and_deviation(p),
            F.coalesce(F.round(F.exp(mean), 1), F.lit(0.0)).alias(f"{p}_geo_avg"),
            F.round(mean, 6).alias(f"{p}_log_geo_avg"),
        ]

    return _per_streamer(statistics, streamers, columns)


def baseline_geo(statistics: DataFrame, streamers: DataFrame) -> DataFrame:
    """Baseline of the group branch; ``{p}_log_geo_avg`` is not rounded."""

    def columns(p: str) -> list[Column]:
        return [
            *_mean_and_deviation(p),
            F.col(f"{p}_ln_mean").alias(f"{p}_log_geo_avg"),
        ]

    return _per_streamer(statistics, streamers, columns)
