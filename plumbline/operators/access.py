"""Hard access gates, as predicates that give the reason of a denial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.functions import vocabulary as v
from plumbline.functions.expressions import SPARK


def gated(rows: DataFrame) -> DataFrame:
    """rows with denial (null if allowed). They hold nodes with their caller's columns:
    clearance, caller_tenant, trusted_approvers and allow_unapproved."""
    return rows.withColumn("denial", F.expr(x.denial(SPARK)))


def suppressed(rows: DataFrame) -> DataFrame:
    """query_id, id, reason and detail of gated rows that are denied; nothing else of a node."""
    return rows.where("denial IS NOT NULL").selectExpr("query_id", "id", "'access-control' AS reason", "denial AS detail")


def edge_access(edges: DataFrame, nodes: DataFrame, callers: DataFrame) -> DataFrame:
    """Each caller's edges of its graph with allowed and detail, by both ends' sensitivities."""
    ends = nodes.select("graph_id", "id", "sensitivity")
    rows = edges.join(ends.selectExpr("graph_id", "id AS source_id", "sensitivity AS s1"), ["graph_id", "source_id"]).join(ends.selectExpr("graph_id", "id AS target_id", "sensitivity AS s2"), ["graph_id", "target_id"])
    rows = callers.select("query_id", "graph_id", "clearance").join(rows, "graph_id")
    over = {s: f"{x.sensitivity_level(s)} > {x.clearance_level('clearance')}" for s in ("s1", "s2")}
    text = {s: f"concat('edge {end} sensitivity \"', {s}, '\" exceeds caller clearance \"', clearance, '\"')" for s, end in (("s1", "source"), ("s2", "target"))}
    return rows.withColumn("detail", F.expr(f"CASE WHEN {over['s1']} THEN {text['s1']} WHEN {over['s2']} THEN {text['s2']} END")).withColumn("allowed", F.expr("detail IS NULL"))


def redact_for_reranker(rows: DataFrame, edges: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a caller may hand on: visible nodes, edges with two visible ends, their candidates.

    rows: gated nodes by query_id; edges and candidates by query_id.
    """
    seen = rows.where("denial IS NULL")
    ids = seen.select("query_id", "id")
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), ["query_id", "source_id"], "left_semi").join(ids.withColumnRenamed("id", "target_id"), ["query_id", "target_id"], "left_semi")
    return seen, kept, candidates.join(ids.withColumnRenamed("id", "node_id"), ["query_id", "node_id"], "left_semi")


def redacted_node(rows: DataFrame) -> DataFrame:
    """Only the id survives."""
    return rows.select("id")


def known_sensitivity(column: str = "sensitivity") -> str:
    return f"({column} IN ({x.listed(v.SENSITIVITIES)}))"


def contexts_from_roles(callers: DataFrame) -> DataFrame:
    """caller_id, role, tenant_id, groups to a caller's columns: clearance, groups with the
    tenant, trusted approvers and tenant."""
    role = x.choose("role", v.CLEARANCE_OF_ROLE, "'public'")
    own = "CASE WHEN tenant_id <> '' THEN array(tenant_id) ELSE cast(array() AS array<string>) END"
    return callers.selectExpr("caller_id", f"{role} AS clearance", f"concat({own}, groups) AS groups", f"{own} AS trusted_approvers", "tenant_id AS caller_tenant")


def redacted_trail(hops: DataFrame, rows: DataFrame) -> DataFrame:
    """hops (query_id, slot, place, node_id, ...) without those to unknown or unseen nodes."""
    return hops.join(rows.where("denial IS NULL").selectExpr("query_id", "id AS node_id"), ["query_id", "node_id"], "left_semi")
