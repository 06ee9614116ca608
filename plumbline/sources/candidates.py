"""Reading requests: candidate sets as JSON documents or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.operators.graph import cut
from plumbline.plans.pipeline import Corpus

HOP = "struct<node_id: string, edge_type: string, confidence: double>"
LOCATOR = "struct<document_id: string, section_id: string, section_path: string, page_start: int, page_end: int, table_id: string, row_start: int, row_end: int, char_start: int, char_end: int>"
NODE = f"""struct<id: string, title: string, authors: array<string>, source: string, year: int, type: string, url: string, length_minutes: int, difficulty: int, status: string,
    topics: array<string>, notes: string, goal_fit: double, energy: string, density: string, trust: double, recommended_count: int, text: string, chunk_type: string, token_count: int,
    version: string, sensitivity: string, embedding_model: string, approved_by: array<string>, superseded_by: string, context_prefix: string, community_id: string, tenant_id: string,
    source_trail: array<{HOP}>, origin: string, observed_at: timestamp, updated_at: timestamp, locator: {LOCATOR}, semantic_type: string, attributes: map<string, string>>"""
EDGE = "struct<source_id: string, target_id: string, type: string, confidence: double, note: string, origin: string, version: string, observed_at: timestamp>"
CANDIDATE = f"struct<node_id: string, query_relevance: double, method_scores: array<struct<method: string, rank: int, score: double, weight: double>>, reranker_score: double, rank: int, retrieval_mode: string, source_trail: array<{HOP}>>"
ACCESS = "struct<caller_id: string, groups: array<string>, clearance: string, trusted_approvers: array<string>, attributes: map<string, string>>"
REQUEST = f"query_id string, query string, nodes array<{NODE}>, edges array<{EDGE}>, candidates array<{CANDIDATE}>, generated_at timestamp, token_budget int, query_type string, allow_degraded_plan boolean, access {ACCESS}"

#: Columns of a node that a missing value leaves empty.
NODE_TEXTS = ("title", "source", "type", "url", "status", "notes", "energy", "density", "text", "chunk_type", "version", "sensitivity", "embedding_model", "superseded_by", "context_prefix", "community_id", "tenant_id", "origin", "semantic_type")
NODE_NUMBERS = ("year", "length_minutes", "difficulty", "recommended_count", "token_count")


def filled_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with every column that the operators read, and empty values for missing ones."""
    have = set(nodes.columns)
    out = nodes
    for names, kind, empty in ((NODE_TEXTS, "string", "''"), (NODE_NUMBERS, "int", "0"), (("goal_fit", "trust"), "double", "0.0e0"), (("topics", "approved_by"), "array<string>", "cast(array() AS array<string>)")):
        for name in names:
            out = out.withColumn(name, F.expr(f"coalesce(cast({name} AS {kind}), {empty})" if name in have else empty))
    return out


CORRUPT = "_corrupt_record"


def read_requests(spark: SparkSession, path: str, strict: bool = False, multiline: bool = False) -> DataFrame:
    """Requests in the reading order of their lines, and in a last column the lines that don't
    parse. strict: these are an error."""
    return spark.read.schema(f"{REQUEST}, {CORRUPT} string").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path, multiLine=multiline)


def keyed(requests: DataFrame) -> DataFrame:
    """requests with query_id unique; request_id is the id that they came with.

    The key is the request's own id where no other has it; where it is missing or occurs
    again, the row's place follows after a '#'. Rows are cut first, so that places stay.
    """
    rows = requests.withColumn("request_id", F.coalesce("query_id", F.lit(""))).withColumn("place", F.monotonically_increasing_id())
    rows = cut(rows)
    again = rows.where("request_id <> ''").groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1").select("request_id", F.lit(True).alias("again"))
    rows = rows.join(again, "request_id", "left")
    return rows.withColumn("query_id", F.expr("CASE WHEN request_id = '' OR again THEN concat(request_id, '#', place) ELSE request_id END")).drop("again", "place")


def corpus(requests: DataFrame, now_year: int) -> Corpus:
    """The tables of requests that bring their own graphs; a query's graph is its own.

    Lines that don't parse are no requests; Corpus.corrupt holds them.
    """
    has_corrupt = CORRUPT in requests.columns
    rows = keyed(requests).withColumn("query", F.coalesce("query", F.lit("")))
    corrupt = rows.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record")) if has_corrupt else None
    rows = rows.where(F.col(CORRUPT).isNull()) if has_corrupt else rows
    attribute = lambda name: f"coalesce(access.attributes['{name}'], '')"
    queries = rows.selectExpr(
        "query_id", "request_id", "query_id AS graph_id", "query", "coalesce(access.clearance, '') AS clearance", f"{attribute('tenant_id')} AS caller_tenant",
        "coalesce(access.trusted_approvers, cast(array() AS array<string>)) AS trusted_approvers", f"{attribute('allow_unapproved_agentic_nodes')} = 'true' AS allow_unapproved",
        f"{attribute('query_type')} AS attribute_type", "coalesce(query_type, '') AS query_type", "coalesce(token_budget, 0) AS token_budget", "coalesce(allow_degraded_plan, false) AS allow_degraded",
    )
    nodes = filled_nodes(rows.selectExpr("query_id AS graph_id", "inline(nodes)").withColumn("id", F.coalesce("id", F.lit(""))))
    edges = rows.selectExpr("query_id AS graph_id", "inline(edges)").selectExpr("graph_id", "coalesce(source_id, '') AS source_id", "coalesce(target_id, '') AS target_id", "coalesce(type, '') AS type", "coalesce(confidence, 0.0e0) AS confidence", "coalesce(note, '') AS note")
    candidates = rows.select("query_id", F.posexplode("candidates").alias("pos", "c")).selectExpr("query_id", "coalesce(c.node_id, '') AS node_id", "cast(pos AS bigint) AS pos", "coalesce(c.query_relevance, 0.0e0) AS query_relevance")
    return Corpus(queries, nodes, edges, candidates, now_year, corrupt)


def clamped(candidates: DataFrame) -> DataFrame:
    """A hybrid handoff's candidates: fused upstream, relevance clamped here."""
    return candidates.withColumn("query_relevance", F.expr(x.clamp("query_relevance")))
