"""Reliability bins and Brier score of market prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (BINARY_RESULTS, BINS_DEFAULT, BINS_MAX, BINS_MIN, HORIZON_MAX, HORIZON_MIN,
                         RESOLVED_NO, RESOLVED_YES, TICKER_PLATFORM, TICKER_SETTLED_STATUSES,
                         TOKEN_PLATFORM, TOKEN_TERMINAL_STATUSES)
from ..functions.numbers import quote_midpoint, sql_round, to_double
from ..functions.texts import contains_ci
from .asof import asof_cutoff


def clamp_bins(n: int) -> int:
    return max(BINS_MIN, min(BINS_MAX, n))


def clamp_horizon(seconds: int) -> int:
    return max(HORIZON_MIN, min(HORIZON_MAX, seconds))


def usable(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Pairs with a probability; those outside [0, 1] belong to :func:`rejected`."""
    return pairs.filter(F.col(p).between(0, 1))


def rejected(pairs: DataFrame, group: list[str], p: str = "p") -> DataFrame:
    """How many pairs per group were left out for p outside [0, 1]."""
    return (pairs.filter(F.col(p).isNotNull() & ~F.col(p).between(0, 1))
            .groupBy(*group).agg(F.count(F.lit(1)).alias("n")))


def reliability_bins(pairs: DataFrame, groups: list, group: str = "platform", p: str = "p",
                     y: str = "y", n_bins: int = BINS_DEFAULT) -> DataFrame:
    """Equal-width bins of p with count, mean prediction and observed frequency.

    Every bin of every group in ``groups`` appears; empty ones have n = 0 and NULL means.
    """
    n = clamp_bins(n_bins)
    spark = pairs.sparkSession
    index = F.least(F.floor(F.col(p) * n), F.lit(n - 1)).cast("int")
    stats = (usable(pairs, p).withColumn("bin", index)
             .groupBy(group, "bin")
             .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"),
                  F.avg(F.col(y).cast("double")).alias("obs_freq")))
    frame = (spark.range(n).select(F.col("id").cast("int").alias("bin"))
             .withColumn(group, F.explode(F.array(*[F.lit(g) for g in groups])))
             .withColumn(group, F.col(group).cast(pairs.schema[group].dataType)))
    return (frame.join(stats, [group, "bin"], "left")
            .select(group, "bin",
                    sql_round(F.col("bin") / F.lit(float(n)), 4).alias("lo"),
                    sql_round((F.col("bin") + 1) / F.lit(float(n)), 4).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                    sql_round(F.col("mean_pred"), 4).alias("mean_pred"),
                    sql_round(F.col("obs_freq"), 4).alias("obs_freq")))


def brier(pairs: DataFrame, groups: list, group: str = "platform", p: str = "p",
          y: str = "y") -> DataFrame:
    """Mean squared error of p against the outcome per group; NULL for an empty group."""
    miss = F.col(p) - F.col(y).cast("double")
    stats = (usable(pairs, p).groupBy(group)
             .agg(F.count(F.lit(1)).alias("n"), F.avg(miss * miss).alias("brier")))
    frame = (pairs.sparkSession.range(1)
             .select(F.explode(F.array(*[F.lit(g) for g in groups])).alias(group))
             .withColumn(group, F.col(group).cast(pairs.schema[group].dataType)))
    return (frame.join(stats, group, "left")
            .select(group, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                    sql_round(F.col("brier"), 5).alias("brier")))


def settled(markets: DataFrame, platform: str) -> DataFrame:
    """Resolved markets of one platform that have a start."""
    if platform == TICKER_PLATFORM:
        done = F.col("status").isin(*TICKER_SETTLED_STATUSES) & F.col("result").isin(*BINARY_RESULTS)
    else:
        done = F.col("status").isin(*TOKEN_TERMINAL_STATUSES)
    return markets.filter((F.col("platform") == platform) & done
                          & F.col("game_start_ts").isNotNull())


def paired_conditions(sample: DataFrame, condition: str = "condition_id") -> DataFrame:
    """Rows of conditions with at least two sampled tokens; a NULL condition never counts.

    The count is aggregated before the join, so a large condition is not gathered in one task.
    """
    known = sample.filter(F.col(condition).isNotNull())
    pairs = known.groupBy(condition).agg(F.count(F.lit(1)).alias("__n")).filter("__n >= 2")
    return known.join(pairs.select(condition), condition, "left_semi").select(*sample.columns)


def token_outcome(raw: Column, outcome: Column) -> Column:
    """1 or 0 from the resolution price of the token's outcome, NULL when voided or unreadable."""
    names = F.from_json(F.get_json_object(raw, "$.outcomes"), "array<string>")
    prices = F.from_json(F.get_json_object(raw, "$.outcomePrices"), "array<string>")
    at = F.array_position(names, outcome).cast("int")
    readable = F.forall(prices, lambda x: to_double(x).isNotNull())
    price = F.when(readable, to_double(F.get(prices, F.when(at > 0, at - 1))))
    return F.when(price > RESOLVED_YES, 1.0).when(price < RESOLVED_NO, 0.0)


def _matching(markets: DataFrame, text: str) -> DataFrame:
    if not text.strip():
        return markets.filter(F.col("title").isNotNull() | F.col("event_id").isNotNull())
    return markets.filter(contains_ci(F.col("title"), text.strip())
                          | contains_ci(F.col("event_id"), text.strip()))


def ticker_pairs(markets: DataFrame, candles: DataFrame, horizon: int = 0,
                 text: str = "") -> DataFrame:
    """(p, y) per settled ticker market: quote midpoint before the cutoff against its result."""
    h = clamp_horizon(horizon)
    chosen = (_matching(settled(markets, TICKER_PLATFORM), text)
              .select("platform", "market_id", "result",
                      F.timestamp_seconds(F.col("game_start_ts") - h).alias("cutoff")))
    ticks = (candles.filter((F.col("platform") == TICKER_PLATFORM) & F.col("close").isNotNull())
             .select("platform", "market_id", "ts", "period_min",
                     quote_midpoint(F.col("raw"), F.col("close")).alias("p")))
    last = asof_cutoff(ticks, chosen, ["platform", "market_id"], "cutoff", "ts", ["p"],
                       tie="period_min")
    return (last.join(chosen, ["platform", "market_id"])
            .select("platform", "market_id", "p",
                    F.when(F.col("result") == "yes", 1.0).otherwise(0.0).alias("y")))


def token_pairs(markets: DataFrame, price_points: DataFrame, horizon: int = 0,
                text: str = "") -> DataFrame:
    """(p, y) per closed token, only of conditions whose tokens were both priced."""
    h = clamp_horizon(horizon)
    chosen = (_matching(settled(markets, TOKEN_PLATFORM), text)
              .filter(F.get_json_object("raw", "$.outcomePrices").isNotNull())
              .select("platform", "market_id", "condition_id",
                      token_outcome(F.col("raw"), F.col("outcome")).alias("y"),
                      F.timestamp_seconds(F.col("game_start_ts") - h).alias("cutoff")))
    ticks = (price_points.filter(F.col("platform") == TOKEN_PLATFORM)
             .select("platform", "market_id", "ts", "fidelity", F.col("price").alias("p")))
    last = asof_cutoff(ticks, chosen, ["platform", "market_id"], "cutoff", "ts", ["p"],
                       tie="fidelity")
    sample = last.join(chosen, ["platform", "market_id"])
    return (paired_conditions(sample).filter(F.col("y").isNotNull())
            .select("platform", "market_id", "p", "y"))


def calibration_pairs(markets: DataFrame, price_points: DataFrame, candles: DataFrame,
                      horizon: int = 0, text: str = "") -> DataFrame:
    return (ticker_pairs(markets, candles, horizon, text)
            .unionByName(token_pairs(markets, price_points, horizon, text)))


def calibration(markets: DataFrame, price_points: DataFrame, candles: DataFrame,
                horizon: int = 0, text: str = "", n_bins: int = BINS_DEFAULT) -> DataFrame:
    """Reliability bins of both platforms with each platform's total and Brier score."""
    pairs = calibration_pairs(markets, price_points, candles, horizon, text)
    groups = [TICKER_PLATFORM, TOKEN_PLATFORM]
    bins = reliability_bins(pairs, groups, n_bins=n_bins)
    score = brier(pairs, groups).withColumnRenamed("n", "total_n")
    return bins.join(score, "platform")

