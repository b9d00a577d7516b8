"""Request logs: trailing rates, monthly budgets, cache hits.

A log has few providers, so one key may hold most rows. All of these run in blocks of time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from .ordered import row_positions, running_sum, spaced_accepts

US = 1_000_000
TIME_BLOCK_S = 10  # of the busiest provider one task sorts this much


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a UTC timestamp with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def trailing_rate(requests: DataFrame, window_s: int, max_requests: int, tiebreak: str,
                  keys: Sequence[str] = ("provider",)) -> DataFrame:
    """Add in_window, the requests in (now - window, now] up to this one, and throttled: as
    many as allowed came before it in the window. Requests of one moment come one after
    another, by ``tiebreak``.

    Each request enters the line at its time and leaves it one window later, leavers first;
    the running sum of the two is the count. No request is copied into several windows.
    """
    at = micros(F.col("ts"))
    extra = [c for c in requests.columns if c not in keys]
    enter = requests.withColumn("_us", at).withColumn("_delta", F.lit(1).cast("bigint"))
    leave = enter.select(
        *keys,
        *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in extra],
        (F.col("_us") + F.lit(window_s * US)).alias("_us"),
        F.lit(-1).cast("bigint").alias("_delta"),
    )
    line = enter.unionByName(leave)
    block = F.floor(F.col("_us") / F.lit(TIME_BLOCK_S * US))
    counted = running_sum(line, keys, ["_us", "_delta", tiebreak], block, F.col("_delta"), "in_window")
    return counted.where(F.col("_delta") == 1).withColumn(
        "throttled", F.col("in_window") > F.lit(max_requests)
    ).drop("_us", "_delta")


def monthly_budget(requests: DataFrame, limit: int, tiebreak: str) -> DataFrame:
    """Add month, request_no within (provider, month) and allowed. Failed calls count too."""
    timed = requests.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn(
        "_us", micros(F.col("ts"))
    )
    block = F.floor(F.col("_us") / F.lit(TIME_BLOCK_S * US))
    numbered = row_positions(timed, ["provider", "month"], ["_us", tiebreak], block, "request_no")
    return numbered.withColumn("allowed", F.col("request_no") <= limit).drop("_us")


def monthly_usage(requests: DataFrame, limit: int) -> DataFrame:
    """Requests, charged requests and refused requests per provider and month."""
    n = F.count(F.lit(1))
    return (
        requests.groupBy("provider", F.date_format("ts", "yyyy-MM").alias("month"))
        .agg(n.alias("requests"))
        .withColumn("used", F.least("requests", F.lit(limit).cast("bigint")))
        .withColumn("refused", F.col("requests") - F.col("used"))
    )


def cache_lookups(lookups: DataFrame, tiebreak: str, ttl_s: int = lx.CACHE_TTL_S) -> DataFrame:
    """Add hit: the last miss of the same (provider, query) is at most ``ttl_s`` old.

    Hits do not refresh an entry, so misses follow each other by more than the TTL.
    """
    timed = lookups.withColumn("_us", micros(F.col("ts")))
    marked = spaced_accepts(
        timed, ["provider", "query"], "_us", ["_us", tiebreak], ttl_s * US, strict=True, name="_miss")
    return marked.withColumn("hit", ~F.col("_miss")).drop("_us", "_miss")


def cache_report(marked: DataFrame) -> DataFrame:
    """Hits and misses per provider."""
    return marked.groupBy("provider").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )
