"""The entity graph: extraction, links, walks, activation, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.functions import strength as S
from mnemo.functions import text as X
from mnemo.operators.components import connected_components
from mnemo.operators.links import links
from mnemo.operators.search import rank_by, small
from mnemo.sources.durable import durable
from mnemo.sources.tables import import_graph


def entity_index(memories: DataFrame) -> DataFrame:
    """(entity, key, seq): one row for each distinct entity of a memory."""
    return memories.select("key", "seq", F.explode(X.entities(F.col("value"))).alias("entity")).select("entity", "key", "seq")


def ingest(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of semantic memories: a fact per memory and per named value, an entity per capitalised word.

    Facts of memories keep source, created_at and is_verified where ``memories`` has them.
    """
    m = memories.where("memory_type = 'semantic'")
    told = [c for c in ("source", "created_at", "is_verified") if c in m.columns]
    facts = m.select(F.col("key").alias("name"), F.lit("fact").alias("node_type"), F.left("value", F.lit(500)).alias("text"), "importance", "seq", *told)
    words = entity_index(m)
    named = m.select("key", "seq", F.inline(X.key_values(F.col("value")))).select("key", "seq", "name").distinct()
    small = lambda df, c, t: df.select(F.col(c).alias("name"), F.lit(t).alias("node_type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("importance"), "seq")
    every = facts.unionByName(small(words, "entity", "entity"), True).unionByName(small(named, "name", "fact"), True)
    nodes = every.groupBy("name").agg(F.min_by("node_type", F.struct("seq", F.col("node_type") == "entity")).alias("node_type"), F.max("text").alias("text"), F.max("importance").alias("importance"), *[F.max(c).alias(c) for c in told])
    edges = words.select(F.col("key").alias("source"), F.col("entity").alias("target"), F.lit("related_to").alias("relation_type"), F.lit(0.5).alias("weight"))
    return nodes, edges.unionByName(named.select(F.col("key").alias("source"), F.col("name").alias("target"), F.lit("supports").alias("relation_type"), F.lit(0.8).alias("weight")))


def rebuild_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, key) from facts with a ``related_to`` edge to an entity."""
    of = lambda kind, c: nodes.where(F.col("node_type") == kind).select(F.col("name").alias(c))
    e = edges.where("relation_type = 'related_to'").join(of("fact", "source"), "source", "left_semi").join(of("entity", "target"), "target", "left_semi")
    return e.select(F.col("target").alias("entity"), F.col("source").alias("key")).distinct()


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, index) of an exported graph, its index of entities rebuilt."""
    nodes, edges = import_graph(spark, path)
    return nodes, edges, rebuild_index(nodes, edges)


def cross_memory_links(index: DataFrame, max_df: int | None = None) -> DataFrame:
    """(source, target): each memory and every earlier one that shares an entity.

    An entity in n memories gives n(n-1)/2 links, which is what is asked for;
    ``max_df`` leaves out entities in more memories than that.  Each memory is
    written once with its entities and meets blocks of the others in the tasks
    (``links``): no link is shuffled.
    """
    if max_df:
        rare = index.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") <= max_df)
        index = index.join(rare, "entity", "left_semi")
    return links(index)


def memories_by_entity(index: DataFrame, limit: int = 20) -> DataFrame:
    """(entity, memories, keys): how many, and the first ``limit`` in order of key."""
    ranked = index.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy("key")))
    keys = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= limit, F.col("key")))), ",")
    return ranked.groupBy("entity").agg(F.count("*").alias("memories"), keys.alias("keys"))


def entities_of_memory(index: DataFrame) -> DataFrame:
    return index.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("entities"))


def relations(edges: DataFrame, starts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges out of ``starts`` (node), of some types."""
    out = edges.join(starts.select(F.col("node").alias("source")), "source", "left_semi")
    return out.where(F.col("relation_type").isin(types)) if types else out


def traverse(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, node, depth): breadth-first from every start at once, a bounded number of joins."""
    hop = durable(edges.select("source", "target").distinct())
    seen = frontier = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        nxt = frontier.join(hop, F.col("node") == F.col("source")).select("start", F.col("target").alias("node")).distinct()
        frontier = durable(nxt.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def walked_edges(edges: DataFrame, seen: DataFrame, depth: int = 3, types: list[str] | None = None) -> DataFrame:
    """(start, source, target, relation_type, weight): the edges that a walk (``traverse`` to the same depth) went over.

    ``types`` leaves other edges out of the result; the walk does not stop at them.  Edges without a type stay.
    """
    shown = edges.where(F.col("relation_type").isNull() | (F.col("relation_type") == "") | F.col("relation_type").isin(types)) if types else edges
    out = seen.where(F.col("depth") < depth).select("start", F.col("node").alias("source"))
    return shown.join(out, "source").select("start", "source", "target", "relation_type", "weight")


def contradictions(edges: DataFrame) -> DataFrame:
    """(source, target, kind, edges): pairs that are contradicted, and whether they are supported too."""
    has = lambda t: F.bool_or(F.col("relation_type") == t)
    out = edges.groupBy("source", "target").agg(has("contradicts").alias("c"), has("supports").alias("s"), F.count_if(F.col("relation_type").isin("contradicts", "supports")).alias("edges"))
    return out.where("c").select("source", "target", F.when(F.col("s"), "relation_conflict").otherwise("direct_contradiction").alias("kind"), "edges")


def maintain(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that have an edge, and edges a little stronger."""
    ends = edges.select(F.col("source").alias("name")).unionByName(edges.select(F.col("target").alias("name"))).distinct()
    return nodes.join(ends, "name", "left_semi"), edges.withColumn("weight", F.least(F.lit(1.0), F.col("weight") + 0.05))


def link_backlog(memories: DataFrame, index: DataFrame, limit: int = 500) -> DataFrame:
    """Semantic memories without an entity, the most important first."""
    return memories.where("memory_type = 'semantic'").join(index.select("key"), "key", "left_anti").orderBy(F.desc("importance"), "key").limit(limit)


def ingest_backlog(memories: DataFrame, index: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) of the backlog's memories; ``counts`` has processed, entities and relations in one row."""
    late = durable(link_backlog(memories, index, limit))
    nodes, edges = ingest(late)
    n = late.agg(F.count("*").alias("processed"))
    counts = n.crossJoin(nodes.agg(F.count_if(F.col("node_type") == "entity").alias("entities"))).crossJoin(edges.agg(F.count("*").alias("relations")))
    return nodes, edges, counts


def components(edges: DataFrame) -> DataFrame:
    """(node, component, size, main): undirected components; the largest is main, of equals the one with the smallest node."""
    named = connected_components(edges.select(F.col("source").alias("u"), F.col("target").alias("v")))
    sizes = named.groupBy("component").agg(F.count("*").alias("size"))
    main = sizes.orderBy(F.desc("size"), "component").limit(1).select(F.col("component").alias("main_component"))
    return named.join(sizes, "component").crossJoin(F.broadcast(main)).select("node", "component", "size", (F.col("component") == F.col("main_component")).alias("main"))


def blind_spots(nodes: DataFrame, edges: DataFrame, now: float, stale_days: float = 30.0, shallow: int = 2) -> DataFrame:
    """(node, kind, severity) of orphans, shallow, stale, isolated and contradictory nodes; nodes have name, updated_at, conflict_id."""
    out = edges.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "name")
    part = components(edges).select(F.col("node").alias("name"), "main")
    base = nodes.join(out, "name", "left").join(part, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    orphan = F.col("n") == 0
    days = (F.lit(now) - F.col("updated_at")) / 86400
    spots = F.array(
        F.when(orphan, F.struct(F.lit("orphan").alias("kind"), F.lit(0.9).alias("severity"))),
        F.when(~orphan & (F.col("n") <= shallow), F.struct(F.lit("shallow").alias("kind"), (0.5 + 0.2 * (shallow - F.col("n"))).alias("severity"))),
        F.when(~orphan & (days > stale_days), F.struct(F.lit("stale").alias("kind"), F.least(F.lit(1.0), 0.4 + days / (3 * stale_days)).alias("severity"))),
        F.when(~orphan & ~F.coalesce("main", F.lit(False)), F.struct(F.lit("isolated").alias("kind"), F.lit(0.6).alias("severity"))),
        F.when(F.col("conflict_id").isNotNull(), F.struct(F.lit("contradictory").alias("kind"), F.lit(0.8).alias("severity"))),
    )
    return base.select(F.col("name").alias("node"), F.inline(F.array_compact(spots))).withColumn("severity", F.round("severity", 6))


def graph_health(spots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts by kind, critical ones, and health within 0 and 1."""
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    kinds = ("orphan", "shallow", "stale", "isolated", "contradictory")
    counts = spots.agg(*map(of, kinds), F.count_if(F.col("severity") >= 0.7).alias("critical"))
    sizes = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    out = counts.crossJoin(sizes)
    penalty = (0.3 * F.col("orphan") + 0.15 * F.col("shallow") + 0.05 * F.col("stale") + 0.1 * F.col("isolated")) / F.greatest(0.5 * F.col("nodes"), F.lit(1.0))
    density = F.coalesce(F.try_divide(F.col("edges").cast("double"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0))
    health = S.clamp(1 - F.least(F.lit(1.0), penalty) + F.least(F.lit(0.2), 0.2 * density))
    return out.withColumn("health", F.round(F.when(F.col("nodes") > 0, health).otherwise(0.0), 6))


def graph_stats(edges: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, contradictions, density and, with ``index`` (entity, key), entity_links."""
    ends = edges.select(F.col("source").alias("n")).unionByName(edges.select(F.col("target").alias("n")))
    n = ends.agg(F.count_distinct("n").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("relation_type") == "contradicts").alias("contradictions"))
    out = n.crossJoin(e).withColumn("density", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9))
    return out if index is None else out.crossJoin(index.select("entity", "key").distinct().agg(F.count("*").alias("entity_links")))


def entity_overlap_boost(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, key, boost): .2 for each shared entity, at most .4."""
    q = small(queries.select("query_id", F.explode(X.entities(F.col("query"))).alias("entity")))
    shared = index.join(q, "entity").groupBy("query_id", "key").agg(F.count("*").alias("n"))
    return shared.select("query_id", "key", F.least(F.lit(0.4), F.round(0.2 * F.col("n"), 6)).alias("boost"))


def metadata_edges(memories: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(source, target, relation_type, weight, edge_seq) from the list ``relations`` in a memory's JSON metadata.

    Its members are [type, target] or {"target", "type", "strength"}; a missing
    type is ``related_to``, a missing strength .5.  Other members, empty targets
    and strength zero, which activates nothing, give no edge.
    """
    members = F.from_json(F.get_json_object(metadata, "$.relations"), "array<string>")
    rows = memories.select(F.col("key").alias("source"), F.posexplode(members).alias("n", "x"))
    pair = F.from_json(F.when(F.col("x").startswith("["), F.col("x")), "array<string>")
    named = F.from_json(F.when(F.col("x").startswith("{"), F.col("x")), "target string, type string, strength double")
    rows = rows.withColumns({"pair": pair, "named": named})
    is_pair = F.col("pair").isNotNull() & (F.size("pair") >= 2)
    target = F.when(is_pair, F.get("pair", F.lit(1))).otherwise(F.col("named.target"))
    kind = F.when(is_pair, F.get("pair", F.lit(0))).otherwise(F.coalesce("named.type", F.lit("related_to")))
    strength = F.when(is_pair, 0.5).otherwise(F.coalesce("named.strength", F.lit(0.5)))
    out = rows.select("source", target.alias("target"), kind.alias("relation_type"), strength.alias("weight"), F.col("n").cast("long").alias("edge_seq"))
    return out.where("target <> '' and weight <> 0")


def with_metadata_edges(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges of the graph and of the memories' metadata, numbered so that a node's own edges come first."""
    late = metadata_edges(memories).withColumn("edge_seq", F.col("edge_seq") + (1 << 40))
    return edges.select("source", "target", "relation_type", "weight", F.col("edge_seq").cast("long").alias("edge_seq")).unionByName(late)


def spread_activation(edges: DataFrame, seeds: DataFrame, decay: float = 0.5, hops: int = 3, least: float = 0.1, combine: str = "first") -> DataFrame:
    """(query_id, node, score, hops, path): activation from seeds (query_id, node, score, seed_seq) along edges with edge_seq.

    A hop gives score × decay^hop × strength; what falls below ``least`` is not
    followed.  A node keeps its first visit: sources in order of discovery,
    then edges in order.  ``combine="sum"`` adds the visits of one hop.
    """
    strength = F.when(F.coalesce("weight", F.lit(0.0)) > 0, F.col("weight")).otherwise(0.5)
    hop = edges.select("source", "target", strength.alias("strength"), "edge_seq")
    seen = frontier = seeds.select("query_id", "node", "score", F.lit(0).alias("hops"), F.array("node").alias("path"), F.col("seed_seq").alias("found"))
    for h in range(1, hops + 1):
        new = frontier.join(hop, F.col("node") == F.col("source"))
        new = new.select("query_id", F.col("target").alias("node"), (F.col("score") * decay**h * F.col("strength")).alias("score"), "path", "found", "edge_seq").where(F.col("score") >= least)
        new = new.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        visits = Window.partitionBy("query_id", "node")
        new = new.withColumns({"visit": F.row_number().over(visits.orderBy("found", "edge_seq")), "total": F.sum("score").over(visits)}).where("visit = 1")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("found", "edge_seq"))
        score = F.col("total") if combine == "sum" else F.col("score")
        frontier = durable(new.select("query_id", "node", score.alias("score"), F.lit(h).alias("hops"), F.concat("path", F.array("node")).alias("path"), (F.lit(h).cast("long") * 1_000_000_000 + order).alias("found")))
        seen = seen.unionByName(frontier)
    return seen.select("query_id", "node", "score", "hops", "path")


def graph_recall(queries: DataFrame, memories: DataFrame, edges: DataFrame, now: float, k: int = 5, seeds: int = 5) -> DataFrame:
    """The best ``k`` memories per query by activation from its five most important seeds (query_id, key, importance) and strength."""
    first = rank_by(queries, [F.desc("importance"), F.col("key")], seeds)
    active = spread_activation(edges, first.select("query_id", F.col("key").alias("node"), F.col("importance").alias("score"), F.col("rank").cast("long").alias("seed_seq")))
    top = rank_by(active, [F.desc(F.round("score", 9)), F.col("node")], 2 * k).drop("rank")
    m = memories.withColumn("_s", S.entry_strength(now)["strength"]).select("key", "_s")
    out = top.join(m, top["node"] == m["key"]).select("query_id", "key", F.round(F.col("score") * (0.5 + 0.5 * F.col("_s")), 6).alias("score"))
    return rank_by(out, [F.desc("score"), F.col("key")], k)
