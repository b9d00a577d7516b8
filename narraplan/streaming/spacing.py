"""Greedy spacing over a stream: keep an item only if it follows the last kept one by a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inorder import Spacing, in_order


def spaced_stream(items: DataFrame, gap_us: int, strict: bool, delay: str = "0 seconds") -> DataFrame:
    """(stream_key STRING, ts TIMESTAMP, at_us, seq, mark) to (stream_key, at_us, seq, kept)."""
    return in_order(items, Spacing(["stream_key"], gap_us, strict), delay)


def suppress_repeats(lookups: DataFrame, ttl_s: int, delay: str = "0 seconds") -> DataFrame:
    """Cache lookups (provider, query, ts, seq): kept ones are misses."""
    keyed = lookups.select(
        F.concat_ws("\u0001", "provider", "query").alias("stream_key"), "ts",
        F.unix_micros("ts").alias("at_us"), "seq", F.lit(0).cast("bigint").alias("mark"))
    return spaced_stream(keyed, ttl_s * 1_000_000, strict=True, delay=delay)
