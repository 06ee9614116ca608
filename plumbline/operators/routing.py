"""Routing of queries by their words and their graph's metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.functions.expressions import SPARK


def metadata(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a query over its graph's nodes (query_nodes() rows): what routing looks at."""
    basis = edges.groupBy("graph_id").agg(F.expr("bool_or(type = 'decision-basis')").alias("has_decision_basis"))
    some = lambda c, test: F.expr(f"array_sort(collect_set(CASE WHEN {test} THEN {c} END))")
    out = rows.groupBy("query_id", "graph_id").agg(
        some("id", "chunk_type = 'entity'").alias("entity_ids"),
        some("community_id", "community_id <> ''").alias("community_ids"),
        some("semantic_type", "semantic_type <> ''").alias("semantic_types"),
        F.expr("bool_or(chunk_type = 'permission-record')").alias("has_permission"),
    )
    counts = [
        rows.groupBy("query_id", c).count().groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "count")))).alias(f"{c}_counts"))
        for c in ("role", "chunk_type")
    ]
    out = out.join(basis, "graph_id", "left").join(counts[0], "query_id").join(counts[1], "query_id")
    out = out.withColumn("topics", F.expr("array_sort(array_union(community_ids, semantic_types))")).fillna(False, ["has_decision_basis"])
    return out.withColumn("topic_span", F.size("topics")).drop("semantic_types")


def routed(queries: DataFrame, meta: DataFrame) -> DataFrame:
    """query_id, query_type, mode, budget_hint, reason and counterpoint_required."""
    rows = queries.select("query_id", "query").join(meta.select("query_id", "entity_ids", "has_permission", "has_decision_basis", "topic_span"), "query_id", "left")
    rows = rows.fillna(False, ["has_permission", "has_decision_basis"]).fillna(0, ["topic_span"])
    rows = rows.withColumn("toks", F.expr(x.tokens_of("query", SPARK))).withColumn("norm", F.expr("array_join(toks, ' ')"))
    norm_id = f"array_join({x.tokens_of('e', SPARK)}, ' ')"
    exact = f"filter(coalesce(entity_ids, array()), e -> {norm_id} <> '' AND contains(concat(' ', norm, ' '), concat(' ', {norm_id}, ' ')))"
    rows = rows.withColumn("entity", F.expr(f"coalesce(get({exact}, 0), '')"))
    return rows.selectExpr(
        "query_id", f"{x.routed(SPARK, 1)} AS query_type", f"{x.routed(SPARK, 2)} AS mode", f"{x.routed(SPARK, 3)} AS budget_hint", f"{x.routed(SPARK, 4)} AS reason",
    ).withColumn("counterpoint_required", F.expr("query_type = 'Adversarial'"))
