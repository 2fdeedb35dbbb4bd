"""Beliefs of several agents: push, pull, merge, consensus, divergence, vector clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.operators.search import small


def push(beliefs: DataFrame, entries: DataFrame) -> DataFrame:
    """Beliefs of each (agent, key) with entries merged in: strictly newer ones replace."""
    both = beliefs.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("agent_id", "key").orderBy(F.desc("created_at"), "_new", "seq"))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def pull(beliefs: DataFrame, into: DataFrame, since: float = 0.0, sources: DataFrame | None = None) -> DataFrame:
    """What the agents of ``into`` (agent_id) adopt: the newest entry of another agent that is newer than their own.

    Each key's two newest entries of different agents are enough to answer for
    any agent, so agents are not multiplied with all entries.  The answer has
    a row for each agent and key still, so few agents (counted) are broadcast.
    """
    offered = beliefs.join(sources, "agent_id", "left_semi") if sources is not None else beliefs
    offered = offered.where(F.col("created_at") >= since)
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("created_at"), "seq"))
    best = offered.withColumn("_n", n).where("_n <= 2").select("key", F.col("agent_id").alias("from_agent"), "value", "created_at", "seq", "_n")
    asked = best.join(small(into.select("agent_id").distinct()), F.col("agent_id") != F.col("from_agent"))
    first = F.row_number().over(Window.partitionBy("agent_id", "key").orderBy("_n"))
    asked = asked.withColumn("_k", first).where("_k = 1")
    own = beliefs.select("agent_id", "key", F.col("created_at").alias("own_at"))
    return asked.join(own, ["agent_id", "key"], "left").where("own_at is null or created_at > own_at").select("agent_id", "key", "from_agent", "value", "created_at")


def merge(beliefs: DataFrame, agents: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (a, b) and key: the value both hold afterwards, and whether they disagreed.

    A missing belief is copied; of two values that of the more reliable agent
    stays, that of ``a`` if they are equally reliable.
    """
    trust = agents.select("agent_id", "reliability")
    side = lambda s: (
        pairs.join(beliefs.join(trust, "agent_id"), F.col(s) == F.col("agent_id")).select("a", "b", "key", F.struct("value", "reliability").alias(f"in_{s}"))
    )
    both = side("a").join(side("b"), ["a", "b", "key"], "full")
    conflict = F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("in_a.value").eqNullSafe(F.col("in_b.value"))
    taken = F.when(F.col("in_a").isNull() | (conflict & (F.col("in_b.reliability") > F.col("in_a.reliability"))), F.col("in_b.value")).otherwise(F.col("in_a.value"))
    return both.select("a", "b", "key", taken.alias("value"), conflict.alias("conflict"), (F.col("in_a").isNull() | F.col("in_b").isNull()).alias("copied"))


def consensus(beliefs: DataFrame, agents: DataFrame) -> DataFrame:
    """(key, value, votes, holders) for keys with several values: most votes, then the most reliable holder, then the earliest."""
    held = beliefs.join(agents, "agent_id")
    votes = held.groupBy("key", "value").agg(F.count("*").alias("votes"), F.max("reliability").alias("trust"), F.min("seq").alias("first"))
    by_key = Window.partitionBy("key")
    rank = F.row_number().over(by_key.orderBy(F.desc("votes"), F.desc("trust"), "first"))
    out = votes.withColumns({"n": rank, "kinds": F.count("*").over(by_key), "holders": F.sum("votes").over(by_key)})
    return out.where("n = 1 and kinds > 1 and holders > 1").select("key", "value", "votes", "holders")


def apply_consensus(decided: DataFrame, agents: DataFrame) -> DataFrame:
    """The winner of every decided key for every agent; agents are a small table by nature."""
    return decided.select("key", "value").crossJoin(agents.select("agent_id"))


def divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, status, value_a, value_b) where two agents' beliefs differ."""
    x = a.select("key", F.col("value").alias("value_a"), F.lit(True).alias("in_a"))
    y = b.select("key", F.col("value").alias("value_b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "missing_in_a").when(F.col("in_b").isNull(), "missing_in_b").when(~F.col("value_a").eqNullSafe(F.col("value_b")), "conflict")
    return x.join(y, "key", "full").withColumn("status", status).where("status is not null").select("key", "status", "value_a", "value_b")


def vclock_merge(a: Column, b: Column) -> Column:
    """Element-wise maximum of two clocks."""
    zero = F.lit(0).cast("long")
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, zero), F.coalesce(y, zero)))


def vclock_compare(a: Column, b: Column) -> Column:
    """before, after, concurrent or equal; a missing element is 0."""
    zero = F.lit(0).cast("long")
    pairs = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, zero).alias("x"), F.coalesce(y, zero).alias("y"))))
    less, more = F.exists(pairs, lambda p: p["x"] < p["y"]), F.exists(pairs, lambda p: p["x"] > p["y"])
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def vclock_tick(events: DataFrame) -> DataFrame:
    """(agent_id, clock): one tick for each event of a key."""
    n = events.groupBy("agent_id", "key").agg(F.count("*").alias("n"))
    return n.groupBy("agent_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("clock"))


def sync_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("agent_id").alias("agents"), F.count("*").alias("syncs"), F.count_distinct(F.when(F.col("op_type") != "delete", F.col("agent_id"))).alias("active_agents"))
