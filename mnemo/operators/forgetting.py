"""Decay passes, forgetting, limits and reinforcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import strength as S


def decay_pass(memories: DataFrame, now: float, prune: bool = True) -> DataFrame:
    """Kept rows with their strength at ``now``: one projection, no shuffle.

    ``last_accessed`` stays, so a second pass counts the whole time again: run
    once for each ``now``.
    """
    out = memories.withColumn("_s", S.entry_strength(now))
    out = out.withColumns({"current_strength": F.col("_s.strength"), "decay_factor": F.col("_s.factor"), "decay_phase": F.col("_s.phase"), "ltp": F.col("_s.ltp"), "updated_at": F.lit(now)}).drop("_s")
    return out.where(F.col("current_strength") >= S.by_value(F.col("memory_type"), S.PRUNE_BELOW, 0.05)) if prune else out


def decay_counts(memories: DataFrame, now: float) -> DataFrame:
    """scanned, updated and pruned of a pass."""
    new = S.entry_strength(now)["strength"]
    pruned = new < S.by_value(F.col("memory_type"), S.PRUNE_BELOW, 0.05)
    return memories.agg(F.count("*").alias("scanned"), F.count_if(~pruned).alias("updated"), F.count_if(pruned).alias("pruned"))


def decay_preview(profiles: DataFrame, days: int) -> DataFrame:
    """(id, day, strength): compounding day by day, up to the first value under 0.001."""
    ltp = S.ltp_status(F.col("importance"), F.col("verification_score"), F.col("access_count"))
    each = profiles.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days))))
    factor = F.least(F.lit(1.0), S.decay_factor(F.col("day").cast("double"), F.col("memory_type"), ltp) * S.access_boost(F.col("access_count")))
    by_day = Window.partitionBy("id").orderBy("day")
    raw = F.exp(F.sum(F.log(factor)).over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    out = each.withColumn("raw", raw).withColumn("before", F.lag("raw").over(by_day))
    return out.where("before is null or before >= 0.001").select("id", "day", F.round("raw", 4).alias("strength"))


def reinforced(accesses: DataFrame) -> DataFrame:
    """Strength after each access (key, seq, strength0): + 0.05 / (1 + 0.1 n), at most 1.

    Gains are never negative, so the clamp is the least of 1 and a running sum.
    """
    by_seq = Window.partitionBy("key").orderBy("seq")
    gain = F.lit(0.05) / (1 + 0.1 * (F.row_number().over(by_seq) - 1))
    out = accesses.withColumn("gain", gain)
    total = F.sum("gain").over(by_seq.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("strength", F.least(F.lit(1.0), F.col("strength0") + total)).drop("gain")


def forget_stale(memories: DataFrame, now: float) -> DataFrame:
    """Ended or weak rows with the action taken: protect (strength at least 0.2), archive (strength 0) or delete."""
    stale = memories.where((F.col("invalid_at") < now) | (F.col("current_strength") < 0.1))
    action = F.when(S.is_protected(), "protect").when(F.col("access_count") >= 3, "archive").otherwise("delete")
    out = stale.withColumn("action", action)
    return out.withColumn("current_strength", F.when(F.col("action") == "protect", F.greatest("current_strength", F.lit(0.2))).otherwise(0.0))


def top_per_group(df: DataFrame, by: str | list[str], order: list[Column], k: int, salts: int = 0) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``.

    With ``salts`` a group is first cut down within that many parts, so that a
    handful of huge groups is not a handful of tasks.
    """
    by = [by] if isinstance(by, str) else by
    if salts:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        n = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))
        df = df.withColumn("_salt", part).withColumn("_n", n).where(F.col("_n") <= k).drop("_salt", "_n")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def enforce_limits(memories: DataFrame, limits: dict[str, int] | None = None, candidates: int = 200) -> DataFrame:
    """For types over 90 % of their limit: the weakest fifth of the top ``candidates`` by importance, with the action taken."""
    limits = S.MAX_ENTRIES if limits is None else limits
    n = memories.groupBy("memory_type").agg(F.count("*").alias("n"))
    full = F.broadcast(n.where(F.col("n") > 0.9 * S.by_value(F.col("memory_type"), limits, 5000)).select("memory_type"))
    top = top_per_group(memories.join(full, "memory_type"), "memory_type", [F.desc("importance"), F.col("key")], candidates, salts=16).drop("rank")
    by_type = Window.partitionBy("memory_type")
    worth = F.col("importance") * F.col("current_strength") * (1 + 0.1 * F.col("access_count"))
    ranked = top.withColumns({"worth": worth, "n": F.count("*").over(by_type)}).withColumn("rank", F.row_number().over(by_type.orderBy("worth", "key")))
    action = F.when(S.is_protected(), "protect").when(F.col("access_count") >= 3, "archive").otherwise("delete")
    return ranked.where("rank <= floor(n * 0.2)").select("key", "memory_type", "worth", action.alias("action"))


def explain_forgetting(memories: DataFrame, now: float) -> DataFrame:
    """(key, reasons): why an entry may go, as text."""
    reason = F.concat_ws(
        "; ",
        F.when(S.is_stale(now), "stale"),
        F.when(S.entry_strength(now)["strength"] < F.col("current_strength"), "expected decay"),
        F.when(~S.is_protected(), "no protection"),
    )
    return memories.select("key", reason.alias("reasons"))


def explain_history(log: DataFrame) -> DataFrame:
    """(key, story): the changes of each key in order, as text."""
    step = F.concat_ws(" ", F.col("id").cast("string"), F.col("op_type"))
    return log.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", step.alias("s")))), lambda x: x["s"]), ", ").alias("story"))


def forgetting_stats(log: DataFrame) -> DataFrame:
    gone = F.col("op_type").isin("delete", "forget")
    out = log.agg(F.count_distinct("key").alias("tracked"), F.count_distinct(F.when(~gone, F.col("key"))).alias("committed"), F.count_distinct(F.when(gone, F.col("key"))).alias("forgotten"))
    return out.withColumn("ratio", F.round(F.col("forgotten") / F.greatest("committed", F.lit(1)), 6))


def consolidation_report(memories: DataFrame, now: float) -> DataFrame:
    """One row of counts: promotable entries, facts, duplicate keys, changed and prunable strengths."""
    new = S.entry_strength(now, F.coalesce("last_accessed", "created_at"))["strength"]
    value = F.try_parse_json("value")
    fact = F.coalesce(F.size(F.json_object_keys("value")) >= 3, F.lit(False)) & value.isNotNull()
    promotable = F.col("memory_type").isin("working", "episodic") & (F.col("access_count") >= 10) & (F.col("current_strength") > 0.5)
    return memories.agg(
        F.count("*").alias("entries"),
        F.count_if(promotable).alias("promotable"),
        F.count_if(fact).alias("facts"),
        (F.count("*") - F.count_distinct("key")).alias("duplicate_keys"),
        F.count_if(F.abs(new - F.col("current_strength")) > 0.01).alias("changed"),
        F.count_if(new < S.by_value(F.col("memory_type"), S.PRUNE_BELOW, 0.05)).alias("prunable"),
    )


def consolidation_health(memories: DataFrame, spots: DataFrame, now: float, window: float = 3600.0) -> DataFrame:
    """One row: strengthened (pairs of keys used within ``window`` of now), blind_spots and health within 0 and 1.

    Uses inside the window all lie less than it apart, so their pairs are
    counted, not made; a use after ``now`` counts as one at ``now``.
    """
    used = memories.where((F.col("last_accessed") > 0) & (F.lit(now) - F.col("last_accessed") < window))
    n = used.agg(F.count_distinct("key").alias("n")).select(F.expr("n * (n - 1) div 2").alias("strengthened"))
    found = spots.agg(F.count("*").alias("blind_spots"))
    return n.crossJoin(found).withColumn("health", F.round(F.greatest(F.lit(0.0), 1 - 0.1 * F.col("blind_spots")), 6))


def co_access_pairs(accesses: DataFrame, window: float = 3600.0, by: str = "session_id", now: float | None = None) -> DataFrame:
    """(by, key_a, key_b): keys whose last accesses lie less than ``window`` seconds apart.

    Times fall into buckets one window long; a key is held against those of
    its own and the next bucket only.
    """
    last = accesses.groupBy(by, "key").agg(F.max("created_at").alias("t"))
    last = last.where(F.lit(now) - F.col("t") < window) if now is not None else last
    last = last.withColumn("bucket", F.floor(F.col("t") / window))
    here = last.select(by, F.col("key").alias("key_a"), F.col("t").alias("t_a"), "bucket")
    there = last.select(by, F.col("key").alias("key_b"), F.col("t").alias("t_b"), "bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("at"))
    same = (here["bucket"] == there["bucket"]) & (F.col("key_a") < F.col("key_b"))
    apart = F.abs(F.col("t_a") - F.col("t_b")) < window
    pairs = here.join(there, (here[by] == there[by]) & (here["bucket"] == there["at"]) & apart & (same | (here["bucket"] != there["bucket"])))
    return pairs.select(here[by], F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
