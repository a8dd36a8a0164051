"""Column functions of the policies: lifetimes, pressure and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds up to which a lifetime snaps, and to what.
TTL_STEPS = ((90, 60), (450, 300), (2700, 900), (5400, 3600), (129600, 86400), (864000, 604800))
#: Pressure below which a level holds.
LEVELS = ((0.70, "normal"), (0.80, "warn"), (0.90, "throttle"), (0.95, "critical"), (0.98, "emergency"))
#: Multiplier, status and seconds to wait by level.
MULTIPLIERS = {"normal": 1.0, "warn": 1.5, "throttle": 2.0, "critical": 3.0, "emergency": 5.0, "shutdown": 10.0}
STATUS = {"throttle": 429, "critical": 503, "emergency": 503, "shutdown": 503}
RETRY_AFTER = {"throttle": 1, "critical": 5, "emergency": 30, "shutdown": 30}


def snapped_ttl(seconds: Column) -> Column:
    out = F
    for most, ttl in TTL_STEPS:
        out = out.when(seconds <= most, ttl)
    return out.otherwise(seconds)


def pressure_level(used: Column) -> Column:
    out = F
    for below, level in LEVELS:
        out = out.when(used < below, level)
    return out.otherwise("shutdown")


def by_level(level: Column, values: dict) -> Column:
    out = F
    for name, value in values.items():
        out = out.when(level == name, value)
    return out


def accepts_writes(level: Column) -> Column:
    return level.isin("normal", "warn", "throttle")


def keep_multiplier(used: Column) -> Column:
    """1 at low pressure and 0 at high, a tangent curve between."""
    curve = 1 - (F.tan((used - 0.5) * F.pi() / 1.2) + 2) / 4
    return F.when(used <= 0.75, 1.0).when(used >= 0.95, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), curve)))


def keep_score(idle_s: Column, accesses: Column, size: Column, used: Column) -> Column:
    """What an entry is worth keeping: recency, frequency and smallness, times the multiplier."""
    often = F.when(accesses == 0, 0.0).otherwise(F.log(1 + F.least(accesses, F.lit(1000)).cast("double")) / F.log(F.lit(1001.0)))
    return (0.4 * F.exp(-idle_s / 3600.0) + 0.4 * often + 0.2 / (1 + size / 1048576.0)) * keep_multiplier(used)


def victims(entries: DataFrame, score: Column, most: int) -> DataFrame:
    """The clean entries (not `dirty`) of the smallest scores, ties by key; dirty ones are not yet written and stay."""
    return entries.filter(~F.col("dirty")).withColumn("score", score).orderBy("score", "key").limit(most)
