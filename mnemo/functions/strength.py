"""Column expressions for strength, decay and staleness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values by memory type: base rate, days to the crossover, exponent after it.
PROFILES = {"working": (0.05, 1.0, 0.5), "episodic": (0.02, 3.0, 0.35), "procedural": (0.015, 7.0, 0.3), "semantic": (0.005, 14.0, 0.2), "spatial": (0.01, 7.0, 0.25)}
PRUNE_BELOW = {"working": 0.3, "episodic": 0.08, "procedural": 0.05, "semantic": 0.03, "spatial": 0.05}
MAX_ENTRIES = {"episodic": 10000, "semantic": 5000, "procedural": 1000, "working": 8, "spatial": 2000}
LEGACY_RATES = {"episodic": 0.02, "procedural": 0.005, "semantic": 0.01, "symbolic": 0.003}
LTP_FACTORS = {"full": 0.1, "weekly": 0.3, "burst": 0.5, "none": 1.0}
DAY = 86400.0


def by_value(column: Column, values: dict, default: object) -> Column:
    """A lookup in a fixed table, as one expression."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def col(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def ltp_status(importance: Column, verification: Column, accesses: Column) -> Column:
    """How well an entry is fixed: full, weekly, burst or none."""
    return (
        F.when((importance >= 0.9) & (verification >= 0.8), "full")
        .when((importance >= 0.7) | ((verification >= 0.5) & (accesses >= 5)), "weekly")
        .when((importance >= 0.5) | (accesses >= 10), "burst")
        .otherwise("none")
    )


def decay_factor(days: Column, memory_type: Column, ltp: Column) -> Column:
    """Exponential up to the type's crossover, a power law after it; 1 for no elapsed time."""
    part = lambda k: by_value(memory_type, {t: p[k] for t, p in PROFILES.items()}, PROFILES["semantic"][k])
    slow = by_value(ltp, LTP_FACTORS, 1.0)
    rate, cross = part(0) * slow, part(1)
    late = F.exp(-rate * cross) * F.pow(days / cross, -(part(2) * slow))
    return F.when(days <= 0, 1.0).when(days < cross, F.exp(-rate * days)).otherwise(late)


def access_boost(accesses: Column, recent: Column | int = 0) -> Column:
    recent = F.lit(recent) if isinstance(recent, int) else recent
    base = F.when(accesses >= 20, 1.2).when(accesses >= 10, 1.1).when(accesses >= 5, 1.05).otherwise(1.0)
    return F.least(base + F.when(recent >= 5, 0.1).when(recent >= 2, 0.05).otherwise(0.0), F.lit(1.3))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def new_strength(strength: Column, memory_type: Column, days: Column, importance: Column, verification: Column, accesses: Column, recent: Column | int = 0) -> Column:
    """struct(strength, factor, phase, ltp) after ``days``; unchanged for none."""
    ltp = ltp_status(importance, verification, accesses)
    factor = F.least(F.lit(1.0), decay_factor(days, memory_type, ltp) * access_boost(accesses, recent))
    cross = by_value(memory_type, {t: p[1] for t, p in PROFILES.items()}, PROFILES["semantic"][1])
    return F.struct(
        F.when(days <= 0, strength).otherwise(clamp(strength * factor)).alias("strength"),
        F.when(days <= 0, 1.0).otherwise(F.round(factor, 6)).alias("factor"),
        F.when(days <= 0, "none").when(days < cross, "exponential").otherwise("power_law").alias("phase"),
        F.when(days <= 0, "none").otherwise(ltp).alias("ltp"),
    )


def touched(last: str = "last_accessed", updated: str = "updated_at", created: str = "created_at") -> Column:
    """Last access, else update, else creation; 0 counts as missing."""
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    return F.coalesce(some(last), some(updated), some(created), F.lit(0.0))


def entry_strength(now: float, since: Column | None = None) -> Column:
    """``new_strength`` of a row of memories at ``now``."""
    days = (F.lit(now) - (touched() if since is None else since)) / DAY
    return new_strength(*map(F.col, ("current_strength", "memory_type")), days, *map(F.col, ("importance", "verification_score", "access_count")))


def legacy_decay(strength: Column, memory_type: Column, hours: Column) -> Column:
    """Compound hourly loss; none under 0.01 hours."""
    return F.when(hours < 0.01, strength).otherwise(clamp(strength * F.pow(1 - by_value(memory_type, LEGACY_RATES, 0.01), hours)))


def is_protected() -> Column:
    return (F.col("importance") >= 0.85) | (F.col("access_count") >= 20) | ((F.col("memory_type") == "procedural") & (F.col("access_count") >= 10))


def is_stale(now: float) -> Column:
    """Past its end, older than its ttl, or weak; an end or ttl of 0 or null means none."""
    ended = (F.col("invalid_at") > 0) & (F.col("invalid_at") < now)
    old = (F.col("ttl") > 0) & (F.lit(now) - F.col("created_at") > F.col("ttl"))
    return F.coalesce(ended, F.lit(False)) | F.coalesce(old, F.lit(False)) | F.coalesce(F.col("current_strength") < 0.1, F.lit(False))
