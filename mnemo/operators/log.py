"""The change log: hash chains, states in time, differences, rollback.

A log has id, op_type, key, micros, before, after and, for chains, chain_id.
Values are JSON text; times are microseconds, so that hashes never depend on
how a double is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.operators.predicates import failed_rules
from mnemo.sources.durable import durable, written

GENESIS = "0" * 64
WRITES, DELETES = ("create", "update", "consolidate"), ("delete", "forget")


def row_hash() -> Column:
    """Hash of one change; missing values are written ``None``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws(":", text("op_type"), text("key"), text("micros"), text("before"), text("after")), 256)


def linked(previous: Column, own: Column) -> Column:
    return F.sha2(F.concat_ws(":", previous, own), 256)


def build_chain(log: DataFrame, by: str = "chain_id", heads: DataFrame | None = None) -> DataFrame:
    """``log`` with data_hash, prev_root and root_hash, one chain for each value of ``by``.

    With ``heads`` (``by``, id, root_hash; see ``chain_heads``) chains go on
    where they ended, and rows at or before a head, which are in them already,
    are left out.  Row hashes are made where the rows are.  A chain can only be
    folded in order: its rows are sorted in one task, which may spill, and pass
    through in batches with the last root alone held.  Chains should be many
    (agent, key or day); ``root_of_roots`` joins them.
    """
    hashed = log.withColumn("data_hash", row_hash())
    if heads is None:
        rows = hashed.select(by, "id", "data_hash", F.lit(GENESIS).alias("head"))
    else:
        ends = heads.select(by, F.col("id").alias("_end"), F.col("root_hash").alias("_head"))
        hashed = hashed.join(ends, by, "left").where("_end is null or id > _end")
        rows = hashed.select(by, "id", "data_hash", F.coalesce("_head", F.lit(GENESIS)).alias("head"))
        hashed = hashed.drop("_end", "_head")
    rows = rows.repartition(by).sortWithinPartitions(by, "id")
    kinds = {f.name: f.dataType.simpleString() for f in hashed.schema}
    roots = rows.mapInArrow(_fold, f"`{by}` {kinds[by]}, id {kinds['id']}, prev_root string, root_hash string")
    return hashed.join(roots, [by, "id"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chain, root = object(), GENESIS
    for batch in batches:
        before, after = [], []
        for c, own, head in zip(batch[0].to_pylist(), batch["data_hash"].to_pylist(), batch["head"].to_pylist(), strict=True):
            if c != chain:
                chain, root = c, head
            before.append(root)
            root = hashlib.sha256(f"{root}:{own}".encode()).hexdigest()
            after.append(root)
        yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(before, pa.string()), pa.array(after, pa.string())], [*batch.schema.names[:2], "prev_root", "root_hash"])


def chain_heads(chained: DataFrame, by: str = "chain_id") -> DataFrame:
    """(by, id, root_hash): where each chain ends; combined before rows move."""
    return chained.groupBy(by).agg(F.max(F.struct("id", "root_hash")).alias("h")).select(by, "h.id", "h.root_hash")


def append_chain(log: DataFrame, path: str, batch: int, by: str = "chain_id") -> None:
    """Adds ``log`` to the chains stored at ``path`` as a batch, with the heads after it.

    ``heads`` of a batch are written last, as one table of all chains, and read
    by the next one.  A batch whose heads are there is left alone; one that was
    cut short is written anew, from the heads before it.
    """
    spark = log.sparkSession
    done = written(spark, f"{path}/heads")
    if batch in done:
        return
    earlier = [b for b in done if b < batch]
    heads = spark.read.parquet(f"{path}/heads/batch={max(earlier)}") if earlier else None
    build_chain(log, by, heads).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    ends = chain_heads(spark.read.parquet(f"{path}/rows/batch={batch}"), by)
    if heads is not None:
        ends = ends.unionByName(heads.join(ends.select(by), by, "left_anti"))
    ends.write.mode("overwrite").parquet(f"{path}/heads/batch={batch}")


def stored_chain(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the chains at ``path``, of whole batches."""
    return spark.read.parquet(*[f"{path}/rows/batch={b}" for b in written(spark, f"{path}/heads")])


def root_of_roots(chained: DataFrame, by: str = "chain_id") -> DataFrame:
    """One hash over all chains: their last roots, chained in order of ``by``; one row per chain is folded."""
    last = chained.groupBy(by).agg(F.max_by("root_hash", "id").alias("root"))
    rows = last.groupBy().agg(F.array_sort(F.collect_list(F.struct(by, "root"))).alias("rows"))
    return rows.select(F.aggregate("rows", F.lit(GENESIS), lambda r, x: linked(r, x["root"])).alias("root"), F.size("rows").alias("chains"))


def verify_chain(chained: DataFrame, by: str = "chain_id") -> DataFrame:
    """Per chain: valid, entries, first_error, stored_root, current_root and root_mismatch.

    Each row is held against its predecessor's stored root.  Up to the first
    error stored and computed roots agree, so this finds what a walk finds,
    without walking.  ``current_root`` is the last root that a walk reaches: the
    one before the first error, or the stored one.
    """
    before = F.lag("root_hash", 1, GENESIS).over(Window.partitionBy(by).orderBy("id"))
    bad = (F.col("data_hash") != row_hash()) | (F.col("root_hash") != linked(before, row_hash()))
    checked = chained.withColumns({"bad": F.coalesce(bad, F.lit(True)), "before_root": before})
    out = checked.groupBy(by).agg(
        (F.count_if("bad") == 0).alias("valid"),
        F.count("*").alias("entries"),
        F.min(F.when(F.col("bad"), F.col("id"))).alias("first_error"),
        F.max_by("root_hash", "id").alias("stored_root"),
        F.min_by("before_root", F.when(F.col("bad"), F.col("id"))).alias("_reached"),
    )
    current = F.when(F.col("valid"), F.col("stored_root")).otherwise(F.coalesce("_reached", F.lit(GENESIS)))
    return out.withColumns({"current_root": current, "root_mismatch": ~F.col("stored_root").eqNullSafe(current)}).drop("_reached")


def history(log: DataFrame, limit: int = 20, keys: DataFrame | None = None) -> DataFrame:
    """The newest ``limit`` changes of each key (of ``keys``, if given), with their rank."""
    log = log.join(keys, "key", "left_semi") if keys is not None else log
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("id")))
    return log.withColumn("rank", rank).where(F.col("rank") <= limit)


def state_at(log: DataFrame, micros: int | Column) -> DataFrame:
    """(key, value) as of a time: the last change of each key decides; combined before rows move."""
    told = log.where(F.col("op_type").isin(*WRITES, *DELETES) & (F.col("micros") <= micros))
    last = told.groupBy("key").agg(F.max_by(F.struct("op_type", "after"), "id").alias("x"))
    return last.where(F.col("x.op_type").isin(*WRITES)).select("key", F.col("x.after").alias("value"))


def states_at(log: DataFrame, times: DataFrame) -> DataFrame:
    """(micros, key, value) for every time of ``times`` (micros): each change holds until its key's next one.

    Changes become intervals.  Time is cut into blocks of halving length; an
    interval is covered by at most two blocks of each length, and a time lies in
    one of each, so they meet by equality.  But for its two ends a block holds
    only answers: no more rows are made than there are answers and ends.
    """
    told = log.where(F.col("op_type").isin(*WRITES, *DELETES))
    by_id = Window.partitionBy("key").orderBy("id")
    # a change that a later id overtook in time never shows
    until = F.min("micros").over(by_id.rowsBetween(1, Window.unboundedFollowing))
    spans = told.select("key", "op_type", "after", F.col("micros").alias("since"), until.alias("until")).where(F.col("op_type").isin(*WRITES) & (F.col("until").isNull() | (F.col("until") > F.col("since"))))
    t = durable(times.select(F.col("micros").cast("long").alias("at")).where("at is not null").distinct())
    n, low, high = t.agg(F.count("*"), F.min("at"), F.max("at")).first()
    low, high = low or 0, high or 0
    finest = ((high - low) // max(1, n)).bit_length()  # about as long as times lie apart
    levels = max(0, ((high - low) >> finest).bit_length() - WIDEST)
    block = lambda c: F.call_function("shiftright", c - F.lit(low), F.lit(finest))
    shown = spans.where((F.col("since") <= high) & (F.col("until").isNull() | (F.col("until") > low)))
    last = F.least(F.coalesce(F.col("until"), F.lit(high + 1)), F.lit(high + 1)) - 1
    cut = shown.select("key", "after", "since", "until", F.inline(blocks(block(F.greatest("since", F.lit(low))), block(last) + 1, levels)))
    at = t.select("at", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).withColumn("block", F.call_function("shiftright", block(F.col("at")), F.col("level")))
    found = cut.join(at, ["level", "block"]).where((F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    return found.select(F.col("at").alias("micros"), "key", F.col("after").alias("value"))


#: The longest blocks are so many halvings shorter than all time, so that none of them is one task's.
WIDEST = 6


def blocks(first: Column, end: Column, levels: int) -> Column:
    """array<struct<level, block>>: the fewest blocks (of 2^level) of levels 0 to ``levels`` that make up [first, end)."""
    start = lambda k: F.call_function("shiftright", first + F.lit((1 << k) - 1), F.lit(k))
    stop = lambda k: F.call_function("shiftright", end, F.lit(k))
    told = lambda k, b: F.struct(F.lit(k).alias("level"), b.alias("block"))
    odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
    ends = [F.when((start(k) < stop(k)) & odd(x), told(k, b)) for k in range(levels) for x, b in ((start(k), start(k)), (stop(k), stop(k) - 1))]
    inner = F.when(start(levels) < stop(levels), F.transform(F.sequence(start(levels), stop(levels) - 1), lambda b: told(levels, b)))
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    return F.concat(F.filter(F.array(*ends), lambda x: x.isNotNull()) if ends else none, F.coalesce(inner, none))


def diff(log: DataFrame, micros_a: int, micros_b: int) -> DataFrame:
    """(key, status, before, after) of keys that differ between two times."""
    a = state_at(log, micros_a).select("key", F.col("value").alias("before"), F.lit(True).alias("in_a"))
    b = state_at(log, micros_b).select("key", F.col("value").alias("after"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return a.join(b, "key", "full").withColumn("status", status).where("status is not null").select("key", "status", "before", "after")


def rollback(current: DataFrame, log: DataFrame, micros: int) -> DataFrame:
    """The plan that turns ``current`` (key, value) into the state at a time: (key, action, before, after)."""
    target = state_at(log, micros).select("key", F.col("value").alias("after"), F.lit(True).alias("wanted"))
    now = current.select("key", F.col("value").alias("before"), F.lit(True).alias("there"))
    action = F.when(F.col("wanted").isNull(), "delete").when(F.col("there").isNull(), "create").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    plan = now.join(target, "key", "full").withColumn("action", action).where("action is not null").select("key", "action", "before", "after")
    return plan


def rejects_rollback(log: DataFrame, micros: int, required: tuple[str, ...] = ()) -> bool:
    """Whether a target value is no JSON, for which a rollback must not start. One count reaches the driver.

    With ``required`` (``memory_type`` for logs of whole entries) a value must
    be an object that has these names; a null value is none.
    """
    names = F.json_object_keys("value")
    bad = F.col("value").isNotNull() & F.try_parse_json("value").isNull()
    for name in required:
        bad = bad | ~F.coalesce(F.array_contains(names, name), F.lit(False))
    return not state_at(log, micros).where(bad).isEmpty()


def rollback_log(plan: DataFrame, micros: int, at: int) -> DataFrame:
    """(op_type, key, micros, before, after): the log rows of a rollback to ``micros`` made at ``at``.

    One row for each key of the plan, and one of ``__system`` with the counts;
    the keys themselves stay in their rows.
    """
    each = plan.select(F.col("action").alias("op_type"), "key", F.lit(at).cast("long").alias("micros"), "before", F.when(F.col("action") != "delete", F.col("after")).alias("after"))
    count = lambda kind, name: F.count_if(F.col("action") == kind).alias(name)
    told = plan.agg(F.to_json(F.struct(count("create", "created"), count("update", "updated"), count("delete", "deleted"))).alias("after"))
    aim = F.to_json(F.struct(F.lit(micros).alias("target_micros")))
    return each.unionByName(told.select(F.lit("rollback").alias("op_type"), F.lit("__system").alias("key"), F.lit(at).cast("long").alias("micros"), aim.alias("before"), "after"))


def apply_plan(current: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, value) after a rollback plan."""
    changed = plan.where("action <> 'delete'").select("key", F.col("after").alias("value"))
    return current.select("key", "value").join(plan, "key", "left_anti").unionByName(changed)


def verify_keys(memories: DataFrame, log: DataFrame, keys: DataFrame, limit: int = 20, chained: DataFrame | None = None, by: str = "chain_id") -> DataFrame:
    """Per wanted key: whether it exists, its value, and its last changes (ids, newest first).

    With ``chained`` (the log with its hashes) also the rules that the entry
    breaks, none for a key that does not exist, and whether all chains are whole.
    """
    last = history(log, limit, keys).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("changes"))
    rules = {"failed_rules": failed_rules()} if chained is not None else {}
    found = memories.withColumns(rules).select("key", "value", F.lit(True).alias("exists"), *rules)
    out = keys.join(found, "key", "left").join(last, "key", "left")
    shown = ["key", F.coalesce("exists", F.lit(False)).alias("exists"), "value", F.coalesce("changes", F.array().cast("array<bigint>")).alias("changes")]
    if chained is None:
        return out.select(*shown)
    whole = verify_chain(chained, by).agg(F.coalesce(F.bool_and("valid"), F.lit(True)).alias("integrity_valid"))  # one row
    return out.crossJoin(F.broadcast(whole)).select(*shown, F.coalesce("failed_rules", F.array().cast("array<string>")).alias("failed_rules"), "integrity_valid")
