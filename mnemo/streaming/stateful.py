"""Stateful streams with named state.

Each is a processor of Spark's ``transformWithStateInPandas`` with value state
in RocksDB, one for each key.  They give what their batch twins give, over
restarts too.  ``use_rocksdb`` has to be called on a session before one of them
is started.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemo.operators.log import GENESIS, row_hash
from mnemo.operators.revise import FIELDS, decide

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def in_order(rows: Iterator[pd.DataFrame], by: str) -> list[dict]:
    """The rows of one key in this batch."""
    held = pd.concat(list(rows)).sort_values(by)
    return held.astype(object).where(held.notna(), None).to_dict("records")


class Chain(StatefulProcessor):
    """A chain's last id and root; rows at or before the head are in it already and are left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "id long, root string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, root = self.head.get() if self.head.exists() else (None, GENESIS)
        out = []
        for r in in_order(rows, "id"):
            if last is not None and r["id"] <= last:
                continue
            before, last = root, r["id"]
            root = hashlib.sha256(f"{root}:{r['data_hash']}".encode()).hexdigest()
            out.append((key[0], last, r["data_hash"], before, root))
        if out:
            self.head.update((last, root))
        yield pd.DataFrame(out, columns=["chain_id", "id", "data_hash", "prev_root", "root_hash"])

    def close(self) -> None:
        pass


def stream_chain(log: DataFrame) -> DataFrame:
    """(chain_id, id, data_hash, prev_root, root_hash) as log rows arrive; ids of a chain must rise from batch to batch."""
    rows = log.select("chain_id", "id", row_hash().alias("data_hash"))
    return rows.groupBy("chain_id").transformWithStateInPandas(Chain(), "chain_id string, id long, data_hash string, prev_root string, root_hash string", "Append", "None")


class Revise(StatefulProcessor):
    """The belief of a key, and how often it was revised."""

    def __init__(self, strategy: str, kinds: dict[str, str]) -> None:
        self.strategy, self.kinds = strategy, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = ", ".join(f"{c} {self.kinds[c]}" for c in FIELDS) + ", entrenchment double, revisions int"
        self.belief = handle.getValueState("belief", held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = (*FIELDS, "entrenchment", "revisions")
        old = dict(zip(names, self.belief.get(), strict=True)) if self.belief.exists() else None
        out = []
        for x in in_order(rows, "seq"):
            decision, old = decide(self.strategy, old, x)
            out.append((key[0], x["seq"], decision))
        self.belief.update(tuple(old[c] for c in names))
        yield pd.DataFrame(out, columns=["key", "seq", "decision"])

    def close(self) -> None:
        pass


def stream_revise(proposals: DataFrame, strategy: str = "entrenchment") -> DataFrame:
    """(key, seq, decision) as proposals arrive; in order of ``seq`` within a batch, batches in order of arrival."""
    for name, kind in (("created_at", "double"), ("is_verified", "boolean")):
        proposals = proposals if name in proposals.columns else proposals.withColumn(name, F.lit(None).cast(kind))
    kinds = {f.name: f.dataType.simpleString() for f in proposals.schema}
    return proposals.select("key", *FIELDS).groupBy("key").transformWithStateInPandas(Revise(strategy, kinds), "key string, seq long, decision string", "Append", "None")
