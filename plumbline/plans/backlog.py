"""Reading backlogs: roles, scores, queue and hygiene of items with a goal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import graph, hygiene
from plumbline.sources import backlog, candidates

KEYS = ("graph_id", "id")


def analysed(items: DataFrame, edges: DataFrame, goal: dict | None, now_year: int) -> tuple[DataFrame, DataFrame]:
    """Scored rows (query_nodes() of one query) and edges; edges with unknown ends are dropped.

    goal: prompt, topics, familiarity, energy and time_minutes, each optional.
    """
    goal = goal or {}
    spark = items.sparkSession
    nodes = candidates.filled_nodes(backlog.as_nodes(items).withColumn("graph_id", F.lit("backlog")))
    ids = nodes.select("id")
    known = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    links = graph.normalised_edges(known.withColumn("graph_id", F.lit("backlog")))
    row = ("backlog", "backlog", goal.get("prompt") or "", list(goal.get("topics") or []), int(goal.get("familiarity") or 0), goal.get("energy") or "", int(goal.get("time_minutes") or 0))
    queries = spark.createDataFrame([row], "query_id string, graph_id string, query string, goal_topics array<string>, familiarity int, goal_energy string, goal_minutes int")
    return graph.cut(graph.query_nodes(queries, graph.graph_table(nodes, links, now_year))), links


def report(rows: DataFrame, edges: DataFrame) -> dict:
    """Clusters and sorted id lists of a backlog; a backlog is one bounded document."""
    flags = hygiene.flags(rows, edges).select("id", "orphan", "stale", "missing_bridge").collect()
    stale = {r["id"] for r in rows.where("stale_hype OR role = 'stale-hype'").select("id").collect()}
    groups: dict[str, list[str]] = {}
    for r in rows.where("cluster IS NOT NULL").select("id", "cluster").collect():
        groups.setdefault(r["cluster"], []).append(r["id"])
    return {
        "duplicate_clusters": sorted(sorted(g) for g in groups.values()),
        "orphan_nodes": sorted(r["id"] for r in flags if r["orphan"]),
        "stale_nodes": sorted(stale),
        "missing_bridges": sorted(r["id"] for r in flags if r["missing_bridge"]),
    }
