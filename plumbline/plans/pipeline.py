"""The whole request: analyse, gate, rank, route, check hygiene, pack."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import access, graph, hygiene, packing, provenance, ranking, routing

DEFAULT_BUDGET = 4000


@dataclass(frozen=True)
class Corpus:
    """Tables of many requests at once.

    queries: query_id, graph_id, query, clearance, caller_tenant, trusted_approvers,
    allow_unapproved, attribute_type (the caller's own query_type attribute), query_type
    (what is asked for; '' to route), token_budget, allow_degraded. nodes, edges: by
    graph_id. candidates: query_id, node_id, pos, query_relevance.
    """

    queries: DataFrame
    nodes: DataFrame
    edges: DataFrame
    candidates: DataFrame
    now_year: int
    corrupt: DataFrame | None = None


def validation_errors(c: Corpus) -> DataFrame:
    """scope (a graph or query), error and id of everything that makes a request invalid.

    Only ids are read; a graph that several queries share is looked at once.
    """
    blank = c.nodes.where("trim(id) = ''").selectExpr("cast(graph_id AS string) AS scope", "'node is missing id' AS error", "id")
    twice = c.nodes.groupBy("graph_id", "id").count().where("count > 1").selectExpr("cast(graph_id AS string) AS scope", "'duplicate node id' AS error", "id")
    ids = c.nodes.select("graph_id", "id")
    wanted = c.candidates.join(c.queries.select("query_id", "graph_id"), "query_id")
    nameless = wanted.where("trim(node_id) = ''").selectExpr("cast(query_id AS string) AS scope", "'candidate is missing node_id' AS error", "node_id AS id")
    lost = wanted.where("trim(node_id) <> ''").withColumnRenamed("node_id", "id").join(ids, ["graph_id", "id"], "left_anti").selectExpr("cast(query_id AS string) AS scope", "'candidate does not match any node' AS error", "id")
    out = blank.unionByName(twice).unionByName(nameless).unionByName(lost)
    for end in ("source_id", "target_id"):
        loose = c.edges.withColumn("id", F.col(end)).join(ids, ["graph_id", "id"], "left_anti")
        out = out.unionByName(loose.selectExpr("cast(graph_id AS string) AS scope", f"'edge {end} does not match any node' AS error", "id"))
    return out


def invalid(c: Corpus) -> DataFrame:
    """query_id and error (the first by name) of queries that are invalid, or whose graph is."""
    keys = c.queries.selectExpr("query_id", "explode(array_distinct(array(cast(query_id AS string), cast(graph_id AS string)))) AS scope")
    errors = validation_errors(c).groupBy("scope").agg(F.min("error").alias("error"))
    return keys.join(errors, "scope").groupBy("query_id").agg(F.min("error").alias("error"))


class Analysis:
    """Lazy tables of a corpus; each is built once, and shared by rank, pack and hygiene."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    @cached_property
    def edges(self) -> DataFrame:
        return graph.normalised_edges(self.corpus.edges)

    @cached_property
    def features(self) -> DataFrame:
        """What one aggregation over the edges gives, without the rest of the table."""
        return graph.edge_features(self.corpus.nodes, self.edges)

    @cached_property
    def authorities(self) -> DataFrame:
        return graph.authority(self.corpus.nodes, self.features)

    @cached_property
    def table(self) -> DataFrame:
        """Cut into the checkpoint folder: a row a node, which goal terms and every query read."""
        return graph.cut(graph.graph_table(self.corpus.nodes, self.edges, self.corpus.now_year))

    @cached_property
    def ppr(self) -> DataFrame:
        """PageRank needs relevance, ids and edges alone."""
        ids = self.corpus.queries.select("query_id", "graph_id").join(self.corpus.nodes.select("graph_id", "id"), "graph_id")
        return graph.personalised_pagerank(ranking.with_relevance(ids, self.corpus.candidates), self.edges, self.corpus.queries)

    @cached_property
    def rows(self) -> DataFrame:
        """Each query with each node of its graph: features, role, relevance, PageRank.

        Cut into the checkpoint folder, as everything below reads it.
        """
        rows = ranking.with_relevance(graph.query_nodes(self.corpus.queries, self.table), self.corpus.candidates)
        rows = rows.drop("query", "clearance", "caller_tenant", "trusted_approvers", "allow_unapproved", "attribute_type", "query_type", "token_budget", "allow_degraded")
        return graph.cut(rows.join(self.ppr, ["query_id", "id"]))

    def _gated(self, callers: DataFrame) -> DataFrame:
        return access.gated(self.rows.join(callers, "query_id"))

    @cached_property
    def rank_rows(self) -> DataFrame:
        """Gated under the caller's whole context, with the request's own budget and type."""
        q = self.corpus.queries
        return self._gated(q.selectExpr("query_id", "clearance", "caller_tenant", "trusted_approvers", "allow_unapproved", "attribute_type AS query_type", "token_budget AS budget"))

    @cached_property
    def ranked(self) -> DataFrame:
        return ranking.ranked(ranking.scored(self.rank_rows))

    @cached_property
    def rank_suppressed(self) -> DataFrame:
        return access.suppressed(self.rank_rows.where("ranked"))

    @cached_property
    def metadata(self) -> DataFrame:
        return routing.metadata(self.rows, self.edges)

    @cached_property
    def recommendations(self) -> DataFrame:
        """What was asked for, or else where the router sends a query, and the resolved budget."""
        asked = self.corpus.queries.selectExpr("query_id", "query_type AS asked", "token_budget")
        rows = routing.routed(self.corpus.queries, self.metadata).join(asked, "query_id")
        given = "asked <> ''"
        return rows.selectExpr(
            "query_id", f"CASE WHEN {given} THEN asked ELSE query_type END AS query_type", f"CASE WHEN {given} THEN '' ELSE mode END AS mode",
            f"CASE WHEN {given} THEN '' ELSE reason END AS reason",
            f"CASE WHEN token_budget > 0 THEN token_budget WHEN {given} THEN {DEFAULT_BUDGET} ELSE budget_hint END AS budget",
        )

    def pack_rows(self, full_context: bool = False) -> DataFrame:
        """Gated for packing: clearance alone counts, unless full_context."""
        q = self.corpus.queries.select("query_id", "query", "clearance", *(["caller_tenant", "trusted_approvers"] if full_context else []))
        if not full_context:
            q = q.selectExpr("*", "'' AS caller_tenant", "cast(array() AS array<string>) AS trusted_approvers")
        return self._gated(q.withColumn("allow_unapproved", F.lit(True)).join(self.recommendations.select("query_id", "query_type", "budget"), "query_id"))

    @cached_property
    def pack_gated(self) -> DataFrame:
        return self.pack_rows()

    @cached_property
    def decided(self) -> DataFrame:
        return graph.cut(packing.decided(ranking.ranked(ranking.scored(self.pack_gated))))

    @cached_property
    def trimmed(self) -> DataFrame:
        return packing.trimmed(self.decided)

    @cached_property
    def slots(self) -> DataFrame:
        return packing.slots(self.trimmed)

    @cached_property
    def left_out(self) -> DataFrame:
        return packing.suppressions(access.suppressed(self.pack_gated.where("ranked")), self.decided, self.trimmed)

    @cached_property
    def trails(self) -> DataFrame:
        return provenance.trails(self.slots, self.edges)

    @cached_property
    def asked(self) -> DataFrame:
        q = self.corpus.queries
        own = ["request_id"] if "request_id" in q.columns else []
        return q.select("query_id", "graph_id", "allow_degraded", *own).join(self.recommendations, "query_id")

    @cached_property
    def plans(self) -> DataFrame:
        return packing.plans(self.asked, self.slots, self.left_out, self.trails)

    @cached_property
    def storable(self) -> DataFrame:
        """Plans with all that memory keeps of them: slots with text, version, reasons and trail."""
        hops = self.trails.groupBy("query_id", "index").agg(F.array_sort(F.collect_list(F.struct("place", "node_id", "edge_type", "confidence"))).alias("hops"))
        texts = self.corpus.nodes.select("graph_id", "id", "text")
        rows = self.slots.withColumn("rationale", F.expr(f"array_join({ranking.rationale()}, '; ')")).join(texts, ["graph_id", "id"]).join(hops, ["query_id", "index"], "left")
        rows = rows.withColumn("source_trail", F.expr("transform(hops, h -> named_struct('node_id', h.node_id, 'edge_type', h.edge_type, 'confidence', h.confidence))"))
        columns = ["index", F.col("id").alias("node_id"), "version", "community_id", F.col("tokens").alias("token_count"), "slot_type", "role", "title", "text", F.col("total").alias("score"), "position", "must_cite", "rationale", "source_trail"]
        slots = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("slots"))
        plans = self.plans.select("query_id", "query_type", "signal", "suppressed", "suppressed_by_reason", "critique_summary")
        return plans.join(slots, "query_id").join(self.asked.select("query_id", "graph_id"), "query_id")

    @cached_property
    def hygiene_flags(self) -> DataFrame:
        return hygiene.flags(self.rows, self.edges)

    @cached_property
    def missing_edges(self) -> DataFrame:
        return hygiene.missing_edges(graph.cut(self.corpus.nodes.select("graph_id", "id", "title", "topics", "community_id", "chunk_type", "superseded_by")), self.stored_edges)

    @cached_property
    def cued_nodes(self) -> DataFrame:
        """Cut into the checkpoint folder: narrow rows that hygiene of whole graphs reads."""
        return graph.cut(graph.cues(self.corpus.nodes, self.corpus.now_year))

    @cached_property
    def stored_edges(self) -> DataFrame:
        return graph.cut(self.edges.drop("raw", "known"))

    @cached_property
    def graph_flags(self) -> DataFrame:
        return graph.cut(hygiene.graph_flags(graph.standing(self.cued_nodes, self.stored_edges, self.corpus.now_year), self.stored_edges))

    @cached_property
    def missing_ends(self) -> DataFrame:
        return graph.cut(hygiene.missing_ends(self.cued_nodes, self.stored_edges))

    @cached_property
    def hygiene(self) -> DataFrame:
        clusters = self.table.where("cluster IS NOT NULL").select("graph_id", "id", "cluster")
        return hygiene.reports(self.corpus.queries, self.hygiene_flags, self.missing_edges, clusters)

    @cached_property
    def hygiene_summary(self) -> DataFrame:
        return hygiene.summaries(self.corpus.queries, self.hygiene_flags)

    @cached_property
    def responses(self) -> DataFrame:
        """One row a query: recommendation, plan with its final signal, status and error.

        A green plan takes the graph's signal; its summary stays. status: ok,
        invalid-candidates (error says why; there is no plan), access-denied-only (nothing
        ranked) or red-signal (red and not allowed to be).
        """
        ranked = self.ranked.groupBy("query_id").agg(F.count("*").alias("n_ranked"))
        denied = self.rank_suppressed.groupBy("query_id").agg(F.count("*").alias("n_denied"))
        graph_signal = hygiene.scores(self.hygiene_flags).selectExpr("query_id", "signal AS graph_signal")
        rows = self.plans.join(self.asked.drop("query_type"), "query_id")
        for extra in (ranked, denied, graph_signal, invalid(self.corpus)):
            rows = rows.join(extra, "query_id", "left")
        rows = rows.withColumn("signal", F.expr("CASE WHEN signal = 'green' THEN coalesce(graph_signal, 'green') ELSE signal END"))
        status = "CASE WHEN error IS NOT NULL THEN 'invalid-candidates' WHEN coalesce(n_ranked, 0) = 0 AND coalesce(n_denied, 0) > 0 THEN 'access-denied-only' WHEN signal = 'red' AND NOT allow_degraded THEN 'red-signal' ELSE 'ok' END"
        rows = rows.withColumn("status", F.expr(status)).drop("graph_signal", "n_ranked", "n_denied")
        # An invalid request has no plan.
        own = [c for c in ("slots", "suppressed", "suppressed_by_reason", "source_trail", "evidence_path", "tokens_used", "critique_summary", "plan_hash", "signal") if c in rows.columns]
        return rows.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in own})
