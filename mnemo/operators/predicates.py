"""Lookups, filters, recall layers, validation and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import strength as S
from mnemo.operators.forgetting import top_per_group
from mnemo.operators.order import global_rank

PRIORITY = {"high": 0, "normal": 1, "low": 2}


def lookup(memories: DataFrame, keys: DataFrame) -> DataFrame:
    return memories.join(keys.select("key"), "key", "left_semi")


def load_by_type(memories: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` entries of each type by importance, then newest."""
    return top_per_group(memories, "memory_type", [F.desc("importance"), F.desc("created_at"), F.col("key")], limit, salts=16)


def high_priority(memories: DataFrame, now: float, limit: int) -> DataFrame:
    """The strongest entries, by importance × strength, that have not ended."""
    live = (F.col("invalid_at").isNull() | (F.col("invalid_at") > now)) & (F.col("current_strength") > 0.1)
    return memories.where(live).withColumn("score", F.col("importance") * F.col("current_strength")).orderBy(F.desc("score"), "key").limit(limit)


def stale(memories: DataFrame, now: float) -> DataFrame:
    """Ended or weak entries; a ttl does not count here."""
    return memories.where((F.col("invalid_at") < now) | (F.col("current_strength") < 0.1))


def recall(layers: list[DataFrame], limit: int = 20, keys: DataFrame | None = None, memory_type: str | None = None, least: float = 0.0, canonical_only: bool = False, skip_prefix: str | None = None) -> DataFrame:
    """Layers overlaid by key, later ones on top; filtered, then the ``limit`` strongest."""
    columns = [c for c in layers[0].columns if all(c in x.columns for x in layers)]
    both = None
    for i, x in enumerate(layers):
        x = x.select(*columns).withColumn("layer", F.lit(i))
        both = x if both is None else both.unionByName(x)
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("layer")))
    out = both.withColumn("_n", n).where("_n = 1").drop("_n").where(F.col("current_strength") >= least)
    out = lookup(out, keys) if keys is not None else out
    out = out.where(F.col("memory_type") == memory_type) if memory_type else out
    out = out.where("canonical") if canonical_only else out
    out = out.where(~F.col("key").startswith(skip_prefix)) if skip_prefix else out
    return out.orderBy(F.desc(F.col("importance") * F.col("current_strength")), "key").limit(limit)


def canonical_order(df: DataFrame, now: float, by: list[str] | None = None) -> DataFrame:
    """``rank`` by contract: canonical, priority, verified, strength × importance, newest; expired rows are gone."""
    live = df.where(~S.is_stale(now))
    order = [F.desc("canonical"), S.by_value(F.col("priority"), PRIORITY, 1), F.desc("is_verified"), F.desc(F.col("current_strength") * F.col("importance")), F.desc("created_at"), F.col("key")]
    return live.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))) if by else global_rank(live, order)


def key_error(key: Column, value: Column) -> Column:
    """Why an entry is refused, null if it isn't."""
    return (
        F.when(key.isNull() | (F.trim(key) == ""), "empty key")
        .when(key.contains("..") | key.contains("/") | key.contains("\\"), "path in key")
        .when(~key.rlike(r"^[a-zA-Z0-9_\-\.\:]{1,256}$"), "bad key")
        .when(F.octet_length(value) > 1024 * 1024, "value too large")
        .when(value.isNotNull() & F.try_parse_json(value).isNull(), "value is no JSON")
    )


def sanitize_text(text: Column) -> Column:
    """Without tags, script links and NULs, trimmed, 500 characters at most."""
    out = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), "(?i)javascript:", "")
    return F.left(F.trim(F.regexp_replace(out, "\x00", "")), F.lit(500))


RULES = ("CAPACITY", "CONSISTENCY", "MONOTONICITY", "TYPE_SAFETY", "NON_NEGATIVITY", "KEY_VALIDITY")


def check_invariants(df: DataFrame, by: str, custom: dict[str, Column] | None = None) -> DataFrame:
    """(by, rule, valid, violations) for the six rules and ``custom`` ones (columns true where a row is fine)."""
    empty = F.col("key").isNull() | (F.col("key") == "")
    negative = F.coalesce(F.least("importance", "current_strength", "verification_score") < 0, F.lit(False))
    several = df.groupBy(by, "key").agg(F.count_distinct("value").alias("n")).groupBy(by).agg(F.count_if(F.col("n") > 1).alias("CONSISTENCY"))
    counts = df.groupBy(by).agg(
        F.greatest(F.count_if(F.col("memory_type") == "working") - 8, F.lit(0)).alias("CAPACITY"),
        F.lit(0).cast("long").alias("MONOTONICITY"),
        F.count_if(F.col("value").isNotNull() & F.try_parse_json("value").isNull()).alias("TYPE_SAFETY"),
        F.count_if(negative).alias("NON_NEGATIVITY"),
        F.count_if(empty).alias("KEY_VALIDITY"),
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in (custom or {}).items()],
    )
    wide = counts.join(several, by)
    return wide.unpivot(by, [*RULES, *(custom or {})], "rule", "violations").withColumn("valid", F.col("violations") == 0)


def verify_transition(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys verified before and no longer after."""
    was = before.where("is_verified").select("key")
    return after.where("not is_verified").select("key").join(was, "key", "left_semi")


def transition_report(before: DataFrame, after: DataFrame, by: str, custom: dict[str, Column] | None = None) -> DataFrame:
    """(by, valid, lost, failed_rules) for every group of ``after``: verified keys that are no longer, and the rules that its entries break.

    ``failed_rules`` is empty where keys were lost, as the loss is then the reason.
    """
    was = before.where("is_verified").select(by, "key").distinct()
    lost = after.where("not is_verified").select(by, "key").distinct().join(was, [by, "key"], "left_semi").groupBy(by).agg(F.count("*").alias("lost"))
    broken = check_invariants(after, by, custom).groupBy(by).agg(F.array_sort(F.collect_list(F.when(~F.col("valid"), F.col("rule")))).alias("failed_rules"))
    out = broken.join(lost, by, "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    rules = F.when(F.col("lost") > 0, F.array().cast("array<string>")).otherwise(F.col("failed_rules"))
    return out.select(by, ((F.col("lost") == 0) & (F.size("failed_rules") == 0)).alias("valid"), "lost", rules.alias("failed_rules"))


def verification_gate(entries: DataFrame, beliefs: DataFrame, now: float, least: float = 0.3) -> DataFrame:
    """``entries`` with status, confidence and reason: STALE, CONFLICT, LOW_CONFIDENCE or PASS, in this order.

    An entry is in conflict with another value of its key, and with a held key
    that its column ``conflicts_with`` names, if it has one.
    """
    held = beliefs.select("key", F.col("value").alias("_held"))
    out = entries.join(held, "key", "left").withColumn("_named", F.lit(None).cast("string"))
    if "conflicts_with" in entries.columns:
        named = beliefs.select(F.col("key").alias("_named")).distinct()
        out = out.drop("_named").join(named, F.col("conflicts_with") == F.col("_named"), "left")
    old = (F.col("ttl") > 0) & (F.lit(now) - F.col("created_at") > F.col("ttl"))
    gone = F.coalesce((F.col("invalid_at") > 0) & (F.col("invalid_at") < now), F.lit(False)) | F.coalesce(old, F.lit(False))
    weak = F.col("current_strength") < least
    differs = F.col("_held").isNotNull() & ~F.col("_held").eqNullSafe(F.col("value"))
    conflict = differs | F.col("_named").isNotNull()
    status = F.when(gone | weak, "STALE").when(conflict, "CONFLICT").when(F.col("verification_score") < least, "LOW_CONFIDENCE").otherwise("PASS")
    confidence = F.when(gone, 0.0).when(weak, F.col("current_strength")).when(conflict, 0.0).otherwise(F.col("verification_score"))
    keys = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(differs, F.col("key")), F.col("_named"))))), ", ")
    reason = (
        F.when(gone, "no longer valid")
        .when(weak, "too weak")
        .when(conflict, F.concat(F.lit("conflicts with "), keys))
        .when(F.col("verification_score") < least, "verified too little")
    )
    return out.withColumns({"status": status, "confidence": confidence, "reason": reason}).drop("_held", "_named")


def recall_status(now: float, intent: Column, relevance: Column | None = None, least: float = 0.3) -> Column:
    """Status of a recalled row: STALE, LOW_CONFIDENCE (weak, or off the intent and of low relevance) or PASS."""
    relevance = F.lit(1.0) if relevance is None else F.coalesce(relevance, F.lit(1.0))
    off = (F.length(intent) > 0) & ~F.lower("key").contains(F.lower(intent)) & (relevance < 0.5)
    return F.when(S.is_stale(now), "STALE").when((F.col("current_strength") < least) | off, "LOW_CONFIDENCE").otherwise("PASS")


def integrity_hash() -> Column:
    """First 16 hex digits of the hash of key, value and type."""
    return F.left(F.sha2(F.concat_ws(":", "key", "value", "memory_type"), 256), F.lit(16))


def failed_rules() -> Column:
    """The rules that an entry breaks by itself."""
    return F.array_compact(
        F.array(
            F.when(F.col("key").isNull() | (F.col("key") == ""), "KEY_VALIDITY"),
            F.when(F.coalesce(F.least("importance", "current_strength", "verification_score") < 0, F.lit(False)), "NON_NEGATIVITY"),
            F.when(F.col("value").isNotNull() & F.try_parse_json("value").isNull(), "TYPE_SAFETY"),
        )
    )


def apply_verification(entries: DataFrame) -> DataFrame:
    """Rows that break no rule become verified (0.8, ``state_verifier``); others list the rules; a null value is left alone."""
    out = entries.withColumn("failed_rules", F.when(F.col("value").isNull(), F.array().cast("array<string>")).otherwise(failed_rules()))
    good = F.col("value").isNotNull() & (F.size("failed_rules") == 0)
    return out.withColumns(
        {
            "is_verified": F.when(F.col("value").isNull(), F.col("is_verified")).otherwise(good),
            "verification_score": F.when(good, 0.8).otherwise(F.col("verification_score")),
            "verification_method": F.when(good, "state_verifier"),
        }
    )


def tag_event(memories: DataFrame, keys: DataFrame, event_id: str) -> tuple[DataFrame, DataFrame]:
    """``memories`` with ``event_id`` set on ``keys``, and the keys that are missing."""
    mark = keys.select("key").distinct().withColumn("_e", F.lit(event_id))
    old = F.col("event_id") if "event_id" in memories.columns else F.lit(None).cast("string")
    out = memories.join(mark, "key", "left").withColumn("event_id", F.coalesce("_e", old)).drop("_e")
    return out, keys.select("key").join(memories, "key", "left_anti")


def event_members(memories: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` members of each event."""
    return top_per_group(memories.where("event_id is not null"), "event_id", [F.desc("created_at"), F.col("key")], limit)


def auto_recall(memories: DataFrame, working: DataFrame, by: str, k: int = 5, pool: int = 200) -> DataFrame:
    """Per ``by``: semantic entries of importance over 0.7 with over 3 accesses that are not in the working set."""
    first = top_per_group(memories.where("memory_type = 'semantic'"), by, [F.desc("importance"), F.col("key")], pool).drop("rank")
    able = first.where("importance > 0.7 and access_count > 3").join(working.select(by, "key"), [by, "key"], "left_anti")
    return top_per_group(able, by, [F.desc("importance"), F.desc("last_accessed"), F.desc("access_count"), F.col("key")], k)


def checkpoint_history(checkpoints: DataFrame, limit: int) -> DataFrame:
    """Per thread the newest checkpoints with ``latest``; map values are cut to 800 characters, sends to 10."""
    out = top_per_group(checkpoints, "thread_id", [F.desc("updated_at"), F.desc("checkpoint_id")], limit)
    return out.withColumns({"latest": F.col("rank") == 1, "values": F.transform_values("values", lambda k, v: F.left(v, F.lit(800))), "pending_sends": F.slice("pending_sends", 1, 10)})
