"""Belief revision: competing values of one key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("entrenchment", "recency", "verification", "importance")


def _score(strategy: str, stored: str | None = None) -> Column:
    held = F.coalesce(F.col(stored), F.lit(0.5)) if stored else F.lit(0.5)
    return {
        "entrenchment": F.greatest(held, F.col("importance")),
        "recency": F.col("created_at"),
        "verification": F.col("is_verified").cast("double"),
        "importance": F.col("importance"),
    }[strategy]


def resolve_candidates(candidates: DataFrame, strategy: str = "entrenchment", stored: str | None = None) -> DataFrame:
    """Candidates of keys with two or more, with score, winner and conflicts_resolved; the earliest of equals wins."""
    scored = candidates.withColumn("score", _score(strategy, stored).cast("double"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "seq"))
    n = F.count("*").over(Window.partitionBy("key"))
    return scored.withColumns({"winner": rank == 1, "conflicts_resolved": n - 1}).where("conflicts_resolved > 0")


FIELDS = ["seq", "value", "importance", "created_at", "is_verified"]


def _accepts(strategy: str, old: dict, new: dict) -> bool:
    """Whether a proposal replaces the held belief; a comparison with a missing number does not."""
    least = lambda a, b: a is not None and b is not None and a >= b
    if strategy == "entrenchment":
        return least(new["importance"], old["entrenchment"])
    if strategy == "recency":
        return least(new["created_at"], old["created_at"])
    if strategy == "verification" and None not in (new["is_verified"], old["is_verified"]) and new["is_verified"] != old["is_verified"]:
        return new["is_verified"]
    return least(new["importance"], old["importance"])


def decide(strategy: str, old: dict | None, x: dict) -> tuple[str, dict]:
    """What becomes of proposal ``x`` (FIELDS) against the held belief, and the belief then (with entrenchment and revisions)."""
    own = None if x["importance"] is None else max(0.0, min(1.0, x["importance"]))
    if old is None:
        return "new", x | {"entrenchment": own, "revisions": 0}
    if old["value"] == x["value"]:
        return "same", old
    if not _accepts(strategy, old, x):
        return "rejected", old
    known = [e for e in (old["entrenchment"], own) if e is not None]
    return "accepted", x | {"entrenchment": max(known, default=None), "revisions": old["revisions"] + 1}


def _replay(strategy: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, old = object(), None
        for batch in batches:
            decisions, entrenchment, revisions = [], [], []
            for x in batch.to_pylist():
                if x["key"] != key:
                    key, old = x["key"], None
                decision, old = decide(strategy, old, x)
                decisions.append(decision)
                entrenchment.append(old["entrenchment"])
                revisions.append(old["revisions"])
            made = [pa.array(decisions, pa.string()), pa.array(entrenchment, pa.float64()), pa.array(revisions, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "decision", "entrenchment", "revisions"])

    return run


def replay(proposals: DataFrame, strategy: str = "entrenchment") -> DataFrame:
    """Proposals (key, seq, value, importance, created_at, is_verified) with the decision on each, and the belief's entrenchment and revisions after it.

    Keys are independent; within one the order of ``seq`` decides, so a key's
    rows are sorted in one task, which may spill, and pass through in batches
    with one belief held.
    """
    rows = proposals.select("key", *FIELDS).repartition("key").sortWithinPartitions("key", *FIELDS)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_replay(strategy), f"{kinds}, decision string, entrenchment double, revisions int")


def revise(proposals: DataFrame, strategy: str = "entrenchment") -> tuple[DataFrame, DataFrame]:
    """(beliefs, decisions): what each key holds in the end, and what became of every proposal."""
    out = replay(proposals, strategy)
    last = F.max_by(F.struct(*FIELDS, "entrenchment", "revisions"), F.struct("revisions", "seq"))
    beliefs = out.where("decision in ('new', 'accepted')").groupBy("key").agg(last.alias("b")).select("key", "b.*")
    return beliefs, out.select("key", "seq", "decision")


def expand(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every proposal overwrites: the last row of each key, and all proposals with ``conflict`` where the value changed."""
    by_seq = Window.partitionBy("key").orderBy("seq")
    before = F.lag("value").over(by_seq)
    later = F.row_number().over(by_seq) > 1
    marked = proposals.withColumn("conflict", later & ~before.eqNullSafe(F.col("value")))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return marked.withColumn("_n", last).where("_n = 1").drop("_n", "conflict"), marked


def contract(beliefs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beliefs without ``keys``, and the dropped ones with their entrenchment."""
    return beliefs.join(keys, "key", "left_anti"), keys.join(beliefs, "key").select("key", "value", "entrenchment", F.lit("contracted").alias("reason"))


def entrenchment(df: DataFrame) -> DataFrame:
    """``df`` with the highest importance of the key so far, within 0 and 1."""
    upto = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("entrenchment", F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "importance"))).over(upto))


def load_beliefs(memories: DataFrame) -> DataFrame:
    """Entries of importance 0.5 or more, entrenched by it."""
    return memories.where("importance >= 0.5").withColumn("entrenchment", F.least(F.lit(1.0), "importance"))


def revision_summary(decisions: DataFrame) -> DataFrame:
    count = lambda *d: F.count_if(F.col("decision").isin(*d))
    return decisions.agg(
        F.count("*").alias("operations"), count("accepted", "rejected").alias("conflicts"), count("accepted").alias("accepted"), count("rejected").alias("rejected"), count("same").alias("unchanged"), count("new").alias("beliefs")
    )


def forget_contradictions(df: DataFrame, protected: Column) -> DataFrame:
    """Of keys with values that differ in their first 50 characters: all but the best value are superseded and weakened.

    The best has the highest verification × importance, the earliest of equals.
    """
    prefix = F.left("value", F.lit(50))
    groups = df.groupBy("key").agg(F.count_distinct(prefix).alias("_kinds"), F.max_by("value", F.struct(F.col("verification_score") * F.col("importance"), -F.col("seq"))).alias("_best"))
    out = df.join(groups, "key")
    lost = (F.col("_kinds") > 1) & ~F.col("value").eqNullSafe(F.col("_best")) & ~protected
    return out.withColumns({"superseded_by": F.when(lost, F.col("key")), "current_strength": F.when(lost, F.col("current_strength") * 0.3).otherwise(F.col("current_strength"))}).drop("_kinds", "_best")
