"""Provenance: source references and the hops that led to a packed node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REF_COLUMNS = ("id", "origin", "source", "url", "version", "observed_at", "updated_at", "locator", "community_id")


def source_ref(nodes: DataFrame) -> DataFrame:
    """graph_id, id and ref, a struct of the reference's fields that nodes have."""
    return nodes.select("graph_id", "id", F.struct(*(F.col(c).alias("node_id" if c == "id" else c) for c in REF_COLUMNS if c in nodes.columns)).alias("ref"))


def trails(slot_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, index, id, place (from 0), node_id, edge_type and confidence of every hop.

    In order: the retrieval of the node, its slot, members of a community summary, the basis
    of a decision. Of hops to one node by one type the first stays.
    """
    base = slot_rows.select("query_id", "graph_id", "index", "id", "chunk_type", "relevance", "total")
    hop = lambda step, kind, value: base.selectExpr("query_id", "index", "id", f"{step} AS step", "'' AS s", "'' AS t", "'' AS note", "id AS node_id", f"'{kind}' AS edge_type", f"{value} AS confidence")
    out = hop(0, "retrieved", "coalesce(relevance, 0.0e0)").unionByName(hop(1, "slot-required", "greatest(0.0e0, least(1.0e0, total / 100.0e0))"))
    e = edges.select("graph_id", "source_id", "target_id", "type", "confidence", "note")
    for step, chunk, kind, own, far in ((2, "community-summary", "community-member-of", "target_id", "source_id"), (3, "decision", "decision-basis", "source_id", "target_id")):
        linked = base.where(f"chunk_type = '{chunk}'").join(e.where(f"type = '{kind}'").withColumn("id", F.col(own)), ["graph_id", "id"])
        out = out.unionByName(linked.selectExpr("query_id", "index", "id", f"{step} AS step", "source_id AS s", "target_id AS t", "note", f"{far} AS node_id", "type AS edge_type", "confidence"))
    order = ["step", "s", "t", "note", "confidence"]
    first = Window.partitionBy("query_id", "index", "node_id", "edge_type").orderBy(*order)
    out = out.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    place = F.row_number().over(Window.partitionBy("query_id", "index").orderBy(*order, "node_id")) - 1
    return out.withColumn("place", place).select("query_id", "index", "id", "place", "node_id", "edge_type", "confidence")
