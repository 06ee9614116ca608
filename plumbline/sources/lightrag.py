"""Importing dual-level retrieval results: local hits are entities, global ones summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions import expressions as x
from plumbline.functions.expressions import SPARK

RESULT = "node_id string, title string, text string, score double, rank int, community_id string, chunk_type string"
LINK = "source_id string, target_id string, type string, confidence double"


def mapped_results(local: DataFrame, far: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and candidates; both tables have query_id and a result's columns."""
    rows = local.selectExpr("*", "'lightrag-local' AS mode", "'entity' AS kind").unionByName(far.selectExpr("*", "'lightrag-global' AS mode", "'community-summary' AS kind"))
    rows = rows.fillna("", ["title", "text", "community_id", "chunk_type"]).fillna(0.0, ["score"]).fillna(0, ["rank"])
    nodes = rows.selectExpr("query_id", "node_id AS id", "title", "text", "text AS notes", "'lightrag' AS source", "'lightrag' AS origin", "0.7e0 AS trust", "coalesce(nullif(chunk_type, ''), kind) AS chunk_type", "'internal' AS sensitivity", "community_id")
    candidates = rows.selectExpr("query_id", "node_id", f"{x.clamp('score')} AS query_relevance", "rank", "mode AS retrieval_mode", "array(named_struct('method', mode, 'rank', rank, 'score', score)) AS method_scores")
    return nodes, candidates


def mapped_links(links: DataFrame) -> DataFrame:
    """Edges with canonical types; the raw type isn't kept."""
    return links.selectExpr("query_id", "source_id", "target_id", f"{x.edge_type('type', SPARK)} AS type", "coalesce(confidence, 0.0e0) AS confidence", "'' AS note")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One handoff document: (query_id, query), nodes, edges and candidates."""
    struct = lambda s: "struct<" + ", ".join(": ".join(f.split(" ")) for f in s.split(", ")) + ">"
    doc = spark.read.schema(f"query_id string, query string, local_results array<{struct(RESULT)}>, global_results array<{struct(RESULT)}>, relationships array<{struct(LINK)}>").json(path, multiLine=True)
    doc = doc.fillna("", ["query_id", "query"])
    nodes, candidates = mapped_results(doc.selectExpr("query_id", "inline(local_results)"), doc.selectExpr("query_id", "inline(global_results)"))
    return doc.select("query_id", "query"), nodes, mapped_links(doc.selectExpr("query_id", "inline(relationships)")), candidates
