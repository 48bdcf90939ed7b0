"""Outlier cuts in ln space against the rounded channel baseline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from airtide.functions.numeric import is_true
from airtide.operators.lookup import attach
from airtide.settings import PLATFORMS, Platform

Test = Callable[[Column], Column]


def beyond(limit: float) -> Test:
    """Two-sided: further than ``limit`` deviations from the mean."""
    return lambda z: F.abs(z) > limit


def below(limit: float) -> Test:
    """One-sided: under ``limit`` deviations."""
    return lambda z: z < limit


def judged(
    facts: DataFrame, baseline: DataFrame, test: Test, only_known: bool
) -> DataFrame:
    """Facts with a verdict ``cut_{p}`` per platform.

    A row without baseline, without viewers or with deviation 0 is never cut. The stream
    number is not looked at: any viewers count. ``only_known`` restricts the facts to the
    channels that ``baseline`` holds.
    """
    bounds = baseline.select(
        F.col("channel_id"),
        *[f"{p.prefix}_ln_{stat}" for p in PLATFORMS for stat in ("avg", "std")],
    )
    if not only_known:  # silent and constant channels cut nothing
        bounds = bounds.where("yt_ln_std > 0 OR tw_ln_std > 0")

    def verdict(p: Platform) -> Column:
        viewers, std = F.col(p.viewers), F.col(f"{p.prefix}_ln_std")
        usable = (viewers > 0) & (std > 0)
        z = (F.ln(F.when(usable, viewers)) - F.col(f"{p.prefix}_ln_avg")) / F.when(
            usable, std
        )
        return is_true(usable & test(z))

    if only_known:  # before rows are counted and shuffled by key
        known = bounds.select(F.col("channel_id").alias("_known"))
        facts = facts.join(known, F.col("channel") == F.col("_known"), "left_semi")
    looked_up = attach(facts, bounds, {"channel_id": F.col("channel")})
    return looked_up.select(
        *[F.col(c) for c in facts.columns],
        *[verdict(p).alias(f"cut_{p.prefix}") for p in PLATFORMS],
    )


def kept(verdicts: DataFrame) -> DataFrame:
    """The judged rows that are an outlier on neither platform."""
    return verdicts.where(~F.col("cut_yt") & ~F.col("cut_tw")).drop("cut_yt", "cut_tw")


def cut_counts() -> list[Column]:
    """Of judged rows: those the YouTube cut removes, then those the Twitch cut removes of the rest."""
    cut_yt, cut_tw = F.col("cut_yt"), F.col("cut_tw")
    return [
        F.count("*").alias("n_before"),
        F.count_if(cut_yt).alias("n_cut_yt"),
        F.count_if(~cut_yt & cut_tw).alias("n_cut_tw"),
        F.count_if(~cut_yt & ~cut_tw).alias("n_after"),
    ]


def outlier_cut(
    facts: DataFrame, baseline: DataFrame, test: Test, only_known: bool = False
) -> DataFrame:
    """Keep the rows that are an outlier on neither platform."""
    return kept(judged(facts, baseline, test, only_known))


def outlier_audit(
    facts: DataFrame, baseline: DataFrame, test: Test, only_known: bool = False
) -> DataFrame:
    return judged(facts, baseline, test, only_known).agg(*cut_counts())
