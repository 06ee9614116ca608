"""Named queries over the derived requests, each with its reference SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.functions import vocabulary as v
from plumbline.functions.expressions import OTHER, SPARK
from plumbline.operators import access, graph, hygiene, memory, packing, provenance, ranking
from plumbline.plans import docgraph, oracles
from plumbline.plans.pipeline import Analysis, validation_errors
from plumbline.sources import graphrag, lightrag


@lru_cache(maxsize=4)
def _analysis(application: str, sf_dir: str) -> Analysis:
    return docgraph.analysis(SparkSession.active(), sf_dir)


def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The corpus' analysis; within a session the queries share what it has cut."""
    return _analysis(spark.sparkContext.applicationId, sf_dir)


def six(column: str, name: str | None = None) -> str:
    return f"{x.rounded(column, 6)} AS {name or column}"


#: What a caller sees of a node by clearance and controlling chunks alone, as plans are packed.
SEEN_BY_CLEARANCE = """n.tenant_id = '' AND list_position(['public', 'internal', 'confidential', 'restricted'], n.sensitivity) <= list_position(['public', 'internal', 'confidential', 'restricted'], q.clearance)
    AND NOT (n.sensitivity IN ('confidential', 'restricted') AND len(n.approved_by) > 0)"""

Made = tuple[Callable[[Analysis], DataFrame], str, tuple[str, ...]]
_made: dict[str, Made] = {}


def over(name: str, select: str, source: str, *, where: str = "", oracle: str | None = None, step: str) -> None:
    """A projection that is written alike for Spark's table source and the oracle's step."""
    def run(a: Analysis) -> DataFrame:
        df = a
        for part in source.split("."):
            df = getattr(df, part)
        return (df.where(where) if where else df).selectExpr(*_split(select))

    _made[name] = (run, f"SELECT {oracle or select} FROM {step}" + (f" WHERE {where}" if where else ""), (step,))


def _split(select: str) -> list[str]:
    """The comma-separated items of a select list."""
    out, depth, quoted, now = [], 0, False, ""
    for c in select:
        quoted ^= c == "'"
        depth += (c in "([" and not quoted) - (c in ")]" and not quoted)
        if c == "," and not depth and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def query(name: str, oracle: str, *needs: str):
    def add(run: Callable[[Analysis], DataFrame]):
        _made[name] = (run, oracle, needs)
        return run

    return add


over("edge_normalize", "graph_id, source_id, target_id, raw, type, known, note", "edges", step="edges")
over("edge_weight", "graph_id, source_id, target_id, weight", "edges", step="edges")
over("legacy_edge_weight", f"graph_id, source_id, target_id, {x.backlog_edge_name('type')} AS name, {x.backlog_edge_weight(x.backlog_edge_name('type'))} AS weight", "corpus.edges", step="raw_edges")
over("token_estimate", f"graph_id, id, {x.estimated_tokens('text', SPARK)} AS estimated, {x.effective_tokens(SPARK)} AS tokens", "corpus.nodes", oracle=f"graph_id, id, {x.estimated_tokens('text', OTHER)} AS estimated, {x.effective_tokens(OTHER)} AS tokens", step="nodes")
over("title_normalize", f"graph_id, id, array_join({x.title_words('title', SPARK)}, ' ') AS words", "corpus.nodes", oracle=f"graph_id, id, array_to_string({x.title_words('title', OTHER)}, ' ') AS words", step="nodes")
over("goal_fit", f"query_id, id, {six('fit')}", "rows", step="fits")
over("freshness_year", f"graph_id, id, {six('backlog_freshness', 'freshness')}", "table", step="graphs")
over("energy_time_fit", f"query_id, id, {six('energy_time_fit')}", "rows", step="parts")
over("stale_hype", "graph_id, id, stale_hype", "table", step="graphs")
over("overview_cue", "graph_id, id, overview_cue", "table", step="graphs")
over("access_gate", "query_id, id, denial IS NULL AS allowed, coalesce(denial, '') AS detail", "rank_rows", where="ranked", step="rank_gated")
over("access_suppressed", "query_id, id, 'access-control' AS reason, denial AS detail", "rank_rows", where="ranked AND denial IS NOT NULL", step="rank_gated")
over("centrality", f"graph_id, id, {six('centrality')}", "features", step="features")
over("degree", "graph_id, id, degree", "features", step="features")
over("incoming_cites", f"graph_id, id, {six('cites')}", "features", step="features")
over("authority", f"graph_id, id, {six('authority')}", "authorities", step="authorities")
over("foundation_score", f"graph_id, id, {six('foundation_score')}", "table", step="graphs")
over("bridge_score", f"graph_id, id, {six('bridge_score')}", "table", step="graphs")
over("roles", "query_id, id, role", "rows", step="parts")
over("legacy_score", "query_id, id, backlog_total AS total, readiness2 AS readiness, freshness2 AS freshness", "rows", step="legacy")
# The walk stops at its tolerance here, and after a fixed number of steps there.
over("ppr", f"query_id, id, {x.rounded('ppr', 5)} AS ppr", "ppr", step="ppr")
over("token_budget_fit", f"query_id, id, {six('token_fit')}", "ranked", step="rank_parts")
over("diversity", f"query_id, id, {six('diversity')}", "ranked", step="rank_parts")
over("rank", "query_id, id, cast(rank AS int) AS rank, total", "ranked", step="rank_ranked")
over("slot_assign", "query_id, id, slot_type, coalesce(reason, '') AS reason, detail", "decided", step="decided")
over("pack_slots", "query_id, `index` AS place, id, slot_type, position, total AS score, tokens", "slots", oracle="query_id, idx AS place, id, slot_type, position, total AS score, tokens", step="slots")
over("pack_suppressed", "query_id, id, reason, detail, score", "left_out", step="left_out")
over("orphans", "query_id, id", "hygiene_flags", where="orphan", step="flags")
over("stale_nodes", "query_id, id", "hygiene_flags", where="stale", step="flags")
over("missing_bridges", "query_id, id", "hygiene_flags", where="missing_bridge", step="flags")
over("missing_edges", "graph_id, source_id, target_id, type, confidence, reason", "missing_edges", step="missing")


@query("rank_by_type", "SELECT query_type, count(*) AS n, round(avg(total) * 1000.0e0) / 1000.0e0 AS mean_total FROM pack_ranked GROUP BY query_type", "pack_ranked")
def _(a: Analysis) -> DataFrame:
    return a.decided.groupBy("query_type").agg(F.count("*").alias("n"), F.expr("round(avg(total) * 1000.0e0) / 1000.0e0 AS mean_total"))


@query("edge_access", f"""SELECT q.query_id, e.source_id, e.target_id, CASE WHEN {x.sensitivity_level('s.sensitivity')} > {x.clearance_level('q.clearance')} THEN 'source' WHEN {x.sensitivity_level('t.sensitivity')} > {x.clearance_level('q.clearance')} THEN 'target' ELSE '' END AS denied_end, count(*) AS n
    FROM queries q JOIN edges e ON e.graph_id = q.graph_id JOIN nodes s ON s.graph_id = e.graph_id AND s.id = e.source_id JOIN nodes t ON t.graph_id = e.graph_id AND t.id = e.target_id GROUP BY ALL""", "queries", "edges", "nodes")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    rows = access.edge_access(a.edges, a.corpus.nodes, a.corpus.queries)
    return rows.groupBy("query_id", "source_id", "target_id", F.expr("CASE WHEN detail LIKE 'edge source%' THEN 'source' WHEN detail LIKE 'edge target%' THEN 'target' ELSE '' END").alias("denied_end")).agg(F.count("*").alias("n"))


@query("rerank_redact", """SELECT e.query_id, e.source_id, e.target_id, e.type FROM (SELECT q.query_id, x.* FROM edges x JOIN queries q ON q.graph_id = x.graph_id) e
    WHERE EXISTS (SELECT 1 FROM rank_gated_all g WHERE g.query_id = e.query_id AND g.id = e.source_id AND g.denial IS NULL) AND EXISTS (SELECT 1 FROM rank_gated_all g WHERE g.query_id = e.query_id AND g.id = e.target_id AND g.denial IS NULL)""".replace("rank_gated_all g", f"(SELECT query_id, n.id, {x.denial(OTHER)} AS denial FROM queries q2 JOIN nodes n ON n.graph_id = q2.graph_id) g"), "queries", "edges", "nodes")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    edges = a.corpus.queries.select("query_id", "graph_id").join(a.edges, "graph_id")
    return access.redact_for_reranker(a.rank_rows, edges, a.corpus.candidates)[1].select("query_id", "source_id", "target_id", "type")


@query("title_pairs", f"SELECT graph_id, a, b, {six('similarity')} FROM pairs", "pairs")
def _(a: Analysis) -> DataFrame:
    return graph.similar_titles(a.corpus.nodes, x.title_words("title", SPARK)).selectExpr("graph_id", "a", "b", six("similarity"))


over("duplicate_clusters", "graph_id, id, cluster", "table", where="cluster IS NOT NULL", step="graphs")


@query("read_queue", """SELECT query_id, id, place, EXISTS (SELECT 1 FROM fold f WHERE f.query_id = u.query_id AND f.at = u.place AND f.taken) AS chosen FROM unread u""", "legacy")
def _(a: Analysis) -> DataFrame:
    return ranking.reading_queue(a.rows).select("query_id", "id", "place", "chosen")


@query("pack_plan", """SELECT g.query_id, g.query_type, g.signal, coalesce((SELECT cast(sum(tokens) AS bigint) FROM slots s WHERE s.query_id = g.query_id), 0) AS tokens_used,
    coalesce((SELECT string_agg(id, '>' ORDER BY idx) FROM slots s WHERE s.query_id = g.query_id), '') AS path, concat('Packed ', (SELECT count(*) FROM slots s WHERE s.query_id = g.query_id), ' slots with ', g.signal, ' hygiene and ', (SELECT count(*) FROM left_out s WHERE s.query_id = g.query_id), ' suppressions.') AS summary
    FROM signals g""", "signals", "left_out")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    return a.plans.selectExpr("query_id", "query_type", "signal", "cast(tokens_used AS bigint) AS tokens_used", "array_join(evidence_path, '>') AS path", "critique_summary AS summary")


@query("plan_hash", """SELECT query_id, sha256(array_to_string(list_concat([cast(query_id AS varchar)], coalesce((SELECT list(id ORDER BY idx) FROM slots s WHERE s.query_id = g.query_id), []), ['--suppressed--'],
    coalesce((SELECT list(id ORDER BY id, reason) FROM left_out s WHERE s.query_id = g.query_id), []), [signal]), chr(0))) AS plan_hash FROM signals g""", "signals", "left_out")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    return a.plans.select("query_id", "plan_hash")


@query("hygiene_score", f"SELECT query_id, {six('score')}, signal FROM scores", "scores")
def _(a: Analysis) -> DataFrame:
    return a.hygiene_summary.selectExpr("query_id", six("score"), "signal")


KINDS = ("orphan", "stale", "missing_bridge", "duplicate", "low_trust", "unapproved")


@query("hygiene_counts", "SELECT query_id, " + ", ".join(f"count(*) FILTER ({k}) AS n_{k}" for k in KINDS) + " FROM flags GROUP BY query_id", "flags")
def _(a: Analysis) -> DataFrame:
    return a.hygiene_summary.select("query_id", *(f"n_{k}" for k in KINDS))


@query("retrieval_targets", """SELECT q.query_id, t.id FROM queries q JOIN scores s ON s.query_id = q.query_id JOIN (
    SELECT query_id, id FROM flags WHERE missing_bridge UNION SELECT q.query_id, m.source_id FROM missing m JOIN queries q ON q.graph_id = m.graph_id UNION SELECT q.query_id, m.target_id FROM missing m JOIN queries q ON q.graph_id = m.graph_id) t ON t.query_id = q.query_id
    WHERE s.score < 0.9e0""", "queries", "scores", "flags", "missing")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    return hygiene.retrieval_targets(a.corpus.queries.withColumn("allow_degraded", F.lit(False)), a.graph_flags, a.missing_ends, threshold=0.9)


@query("suppressed_by_reason", "SELECT query_id, reason, count(*) AS n FROM left_out GROUP BY ALL", "left_out")
def _(a: Analysis) -> DataFrame:
    return a.plans.selectExpr("query_id", "explode(suppressed_by_reason) AS (reason, n)")


@query("must_cite", "SELECT query_id, id, slot_type <> 'support' AS must_cite FROM slots", "slots")
def _(a: Analysis) -> DataFrame:
    return a.plans.selectExpr("query_id", "inline(slots)").select("query_id", F.col("node_id").alias("id"), "must_cite")


def _two(label: str, column: str) -> str:
    return f"printf('{label} %.2f', {column})"


@query("rationale", f"""SELECT query_id, id, concat_ws('; ', {_two('query relevance', 'query_relevance')}, {_two('authority', 'authority')}, {_two('graph importance', 'graph_importance')}, {_two('token budget fit', 'token_fit')},
    CASE WHEN token_count = 0 AND text <> '' THEN concat('token count estimated as ', tokens) END, CASE WHEN unknown_edge THEN 'unknown edge type weighted as related-to' END, CASE WHEN redundancy > 0 THEN {_two('redundancy penalty', 'redundancy')} END,
    CASE WHEN staleness > 0 THEN {_two('staleness penalty', 'staleness')} END, CASE WHEN low_trust > 0 THEN {_two('low trust penalty', 'low_trust')} END, CASE WHEN query_type <> '' THEN concat('query type ', query_type, ' modifier applied') END) AS why FROM rank_ranked""", "rank_ranked")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    return a.ranked.selectExpr("query_id", "id", f"array_join({ranking.rationale()}, '; ') AS why")


@query("explain", """SELECT query_id, id, concat(concat_ws('; ', concat(title, ' is a ', role), CASE WHEN round(fit * 100) / 100 >= 0.7 THEN 'strongly matches the goal' END, CASE WHEN round(centrality * 100) / 100 >= 0.7 THEN 'unlocks several connected items' END,
    CASE WHEN readiness2 < 0.55 THEN 'may need prerequisites first' END, CASE WHEN round(backlog_redundancy * 100) / 100 >= 0.5 THEN 'looks redundant with another backlog item' END, CASE WHEN round(energy_time_fit * 100) / 100 >= 0.8 THEN 'fits the current time/energy budget' END), '.') AS line FROM legacy""", "legacy")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    return a.rows.selectExpr("query_id", "id", f"{ranking.explanation()} AS line")


@query("known_sensitivity", "SELECT graph_id, id, sensitivity IN ('public', 'internal', 'confidential', 'restricted') AS known FROM nodes", "nodes")
def _(a: Analysis) -> DataFrame:
    return a.corpus.nodes.selectExpr("graph_id", "id", f"{access.known_sensitivity()} AS known")


@query("redacted_trail", f"""SELECT h.query_id, h.idx AS slot, h.node_id, h.edge_type FROM (SELECT *, row_number() OVER (PARTITION BY query_id, idx, node_id, edge_type ORDER BY step, s, t, confidence) AS n FROM hops) h
    JOIN (SELECT q.query_id, n.id FROM queries q JOIN nodes n ON n.graph_id = q.graph_id WHERE {SEEN_BY_CLEARANCE}) v ON v.query_id = h.query_id AND v.id = h.node_id WHERE h.n = 1""", "hops", "queries", "nodes")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    rows = a.pack_gated.select("query_id", "id", "denial")
    return access.redacted_trail(a.trails, rows).selectExpr("query_id", "`index` AS slot", "node_id", "edge_type")


@query("source_ref", "SELECT graph_id, id, source, version, community_id FROM nodes", "nodes")
def _(a: Analysis) -> DataFrame:
    return provenance.source_ref(a.corpus.nodes).selectExpr("graph_id", "ref.node_id AS id", "ref.source AS source", "ref.version AS version", "ref.community_id AS community_id")


@query("validation", """SELECT cast(graph_id AS varchar) AS scope, 'edge target_id does not match any node' AS error, concat(target_id, '?') AS id FROM raw_edges WHERE type = 'cites'
    UNION ALL SELECT cast(query_id AS varchar), 'candidate is missing node_id', '' FROM queries""", "raw_edges", "queries")
def _(a: Analysis) -> DataFrame:
    c = a.corpus
    edges = c.edges.unionByName(c.edges.where("type = 'cites'").withColumn("target_id", F.concat("target_id", F.lit("?"))))
    blank = c.queries.selectExpr("query_id", "'' AS node_id", "9L AS pos", "0.0e0 AS query_relevance")
    return validation_errors(replace(c, edges=edges, candidates=c.candidates.unionByName(blank)))


@query("status", """SELECT a.query_id, CASE WHEN NOT EXISTS (SELECT 1 FROM rank_ranked r WHERE r.query_id = a.query_id) AND EXISTS (SELECT 1 FROM rank_gated g WHERE g.query_id = a.query_id AND g.denial IS NOT NULL) THEN 'access-denied-only'
    WHEN (CASE WHEN g.signal = 'green' THEN s.signal ELSE g.signal END) = 'red' AND NOT a.allow_degraded THEN 'red-signal' ELSE 'ok' END AS status FROM asked a JOIN signals g ON g.query_id = a.query_id JOIN scores s ON s.query_id = a.query_id""", "asked", "signals", "scores", "rank_ranked", "rank_gated")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    return a.responses.select("query_id", "status")


@query("graph_metadata", """SELECT m.query_id, array_to_string(entity_ids, ',') AS entities, has_permission, has_decision_basis, cast(topic_span AS int) AS topic_span, (SELECT count(*) FROM rows r WHERE r.query_id = m.query_id AND r.role = 'bridge') AS n_bridges,
    (SELECT count(*) FROM rows r WHERE r.query_id = m.query_id AND r.chunk_type = 'claim') AS n_claims FROM meta m""", "meta")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    return a.metadata.selectExpr("query_id", "array_join(entity_ids, ',') AS entities", "has_permission", "has_decision_basis", "topic_span", "coalesce(role_counts['bridge'], 0L) AS n_bridges", "coalesce(chunk_type_counts['claim'], 0L) AS n_claims")


@query("route", "SELECT a.query_id, a.query_type, CASE WHEN q.query_type <> '' THEN '' ELSE r.mode END AS mode, CASE WHEN q.query_type <> '' THEN '' ELSE r.reason END AS reason, a.budget FROM asked a JOIN routes r ON r.query_id = a.query_id JOIN queries q ON q.query_id = a.query_id", "asked", "routes", "queries")
def _(a: Analysis) -> DataFrame:
    return a.recommendations.select("query_id", "query_type", "mode", "reason", "budget")


@query("source_trail", f"SELECT query_id, idx AS slot, id, node_id, edge_type, {six('confidence')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id, idx, node_id, edge_type ORDER BY step, s, t, confidence) AS n FROM hops) WHERE n = 1", "hops")
def _(a: Analysis) -> DataFrame:
    return a.trails.selectExpr("query_id", "`index` AS slot", "id", "node_id", "edge_type", six("confidence"))


def stored_plans(a: Analysis) -> DataFrame:
    """The derived plans, as a memory table."""
    return memory.records(a.storable, "2026-01-01T00:00:00Z")


#: Who reads the stored plans, as SQL of what the caller may see of a node.
CALLER = {"clearance": "internal", "caller_tenant": "acme", "trusted_approvers": ["ops"]}
SEEN = "(tenant_id IN ('', 'acme') AND sensitivity IN ('public', 'internal') AND NOT (chunk_type IN ('permission-record', 'decision', 'procedure') AND len(approved_by) = 0))"
TOPIC_LIST = "['lang-0', 'lang-1', 'lang-2']"


def _jaccard(topics: str, wanted: str) -> str:
    """Of two lists of distinct lower-case topics."""
    return f"(CASE WHEN len({topics}) = 0 AND len({wanted}) = 0 THEN 1.0e0 ELSE len(list_intersect({topics}, {wanted})) / cast(len(list_distinct(list_concat({topics}, {wanted}))) AS double) END)"


@query("memory_hash", "SELECT query_id, array_to_string(topics, ',') AS topics, plan_hash FROM stored", "stored")
def _(a: Analysis) -> DataFrame:
    return stored_plans(a).selectExpr("cast(query_id AS bigint) AS query_id", "array_join(topics, ',') AS topics", "plan_hash")


@query("memory_store", """SELECT s.query_id, cast(count(*) AS int) AS slots, string_agg(s.id, '>' ORDER BY idx) AS path, cast(sum(tokens) AS bigint) AS tokens_used, sum(length(s.text)) AS characters, cast((SELECT count(*) FROM left_out o WHERE o.query_id = s.query_id) AS int) AS suppressed,
    string_agg(concat(s.id, '=', version), ',' ORDER BY s.id) AS versions FROM slots s JOIN signals g ON g.query_id = s.query_id WHERE g.signal <> 'red' GROUP BY s.query_id""", "slots", "signals", "left_out")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    return stored_plans(a).selectExpr(
        "cast(query_id AS bigint) AS query_id", "size(slots) AS slots", "array_join(evidence_path, '>') AS path", "tokens_used", "aggregate(slots, 0L, (n, s) -> n + length(s.text)) AS characters", "size(suppressed) AS suppressed",
        "array_join(transform(array_sort(map_entries(node_versions)), e -> concat(e.key, '=', e.value)), ',') AS versions",
    )


@query("memory_similar", f"""SELECT p.query_id, round(p.similarity * 1000000.0e0) / 1000000.0e0 AS similarity, coalesce(k.path, '') AS path, coalesce(k.tokens, 0) AS tokens_used FROM (
    SELECT query_id, {_jaccard('topics', TOPIC_LIST)} AS similarity FROM stored) p LEFT JOIN (
    SELECT query_id, string_agg(id, '>' ORDER BY idx) AS path, cast(sum(tokens) AS bigint) AS tokens, bool_or(superseded_by <> '') AS outdated, list_distinct(list(lower(community_id)) FILTER (community_id <> '')) AS topics FROM slots WHERE {SEEN} GROUP BY query_id) k ON k.query_id = p.query_id
    WHERE p.similarity >= 0.70e0 AND {_jaccard('coalesce(k.topics, [])', TOPIC_LIST)} >= 0.70e0 AND NOT coalesce(k.outdated, false)""", "stored", "slots")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    found = memory.similar(stored_plans(a), ["Lang-0", "lang-1 ", "lang-2"], a.corpus.nodes, CALLER)
    return found.selectExpr("cast(query_id AS bigint) AS query_id", six("similarity"), "array_join(evidence_path, '>') AS path", "tokens_used")


@query("memory_regate", f"""SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY idx) - 1 AS int) AS place, id FROM slots WHERE {SEEN} AND query_id IN (SELECT query_id FROM signals WHERE signal <> 'red')""", "slots", "signals")
def _(a: Analysis) -> DataFrame:
    kept, _ = memory.regated(stored_plans(a), a.corpus.nodes, CALLER)
    return kept.selectExpr("cast(query_id AS bigint) AS query_id", "`index` AS place", "id")


#: What is asked for of each stored plan, and how its nodes have changed since: so that every reason comes up.
ASKED_TYPE = "CASE WHEN query_id % 5 = 1 THEN 'Relational' WHEN query_type = 'Factual' AND query_id % 5 = 2 THEN 'Agentic' ELSE query_type END"
CHANGED = "CASE WHEN doc_id % 23 = 3 THEN 'changed' ELSE version END"
REPLACED = "CASE WHEN doc_id % 19 = 5 THEN 'later' ELSE superseded_by END"


@query("memory_reuse", f"""SELECT query_id, CASE WHEN NOT (query_type = asked OR (query_type = 'Factual' AND asked = 'Agentic')) THEN 'query-type' WHEN {_jaccard('topics', 'wanted')} < 0.70e0 THEN 'topic-mismatch' WHEN worst IS NOT NULL THEN split_part(worst, '|', 2) WHEN unseen > 0 THEN 'access-control' ELSE '' END AS reason
    FROM (SELECT p.query_id, p.query_type, p.topics, {ASKED_TYPE.replace('query_id', 'p.query_id').replace('query_type', 'p.query_type')} AS asked, CASE WHEN p.query_id % 7 = 3 THEN ['elsewhere'] ELSE p.topics END AS wanted FROM stored p) p
    JOIN (SELECT query_id AS q, min(CASE WHEN {CHANGED} <> version THEN concat(id, '|version-mismatch') WHEN {REPLACED} <> '' THEN concat(id, '|superseded') END) AS worst, count(*) FILTER (NOT {SEEN}) AS unseen FROM slots GROUP BY query_id) s ON s.q = p.query_id""", "stored", "slots")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    stored = stored_plans(a)
    asked = stored.selectExpr("query_id", "CASE WHEN query_id % 7 = 3 THEN array('elsewhere') ELSE topics END AS topics", f"{ASKED_TYPE} AS query_type")
    now = a.corpus.nodes.withColumn("version", F.expr(CHANGED)).withColumn("superseded_by", F.expr(REPLACED))
    return memory.rejections(stored, asked, now, CALLER).selectExpr("cast(query_id AS bigint) AS query_id", "coalesce(reason, '') AS reason")


#: The seven tables of an export, of all documents: each is a document, a text unit and an
#: entity; topics are communities with a report; every text unit makes a claim.
STATUS = ("", "negative", "true", "disputed")


@query("graphrag_import", """SELECT 'node' AS kind, id, chunk_type AS type, title, trust, token_count, observed_at, 0.0e0 AS confidence FROM (
    SELECT id, 'document' AS chunk_type, title, 0.75e0 AS trust, cast(0 AS bigint) AS token_count, cast(year AS varchar) AS observed_at FROM nodes UNION ALL SELECT concat('u', id), 'chunk', concat('u', id), 0.75e0, token_count, cast(year AS varchar) FROM nodes
    UNION ALL SELECT concat('e', id), 'entity', title, 0.75e0, 0, '' FROM nodes UNION ALL SELECT concat('r', first), 'community-summary', community_id, 0.75e0, 0, '' FROM (SELECT community_id, graph_id, min(id) AS first, list(id) AS ids FROM nodes GROUP BY ALL) UNION ALL SELECT concat('v', id), 'claim', concat('v', id), 0.75e0, 0, '' FROM nodes)
    UNION ALL SELECT 'edge', concat(source_id, '>', target_id), 'related-to', '', 0.0e0, 0, '', CASE WHEN confidence <= 0 OR confidence > 1 THEN 1.0e0 ELSE confidence END FROM raw_edges
    UNION ALL SELECT 'edge', concat('u', id, '>v', id), CASE WHEN g % 4 IN (1, 3) THEN 'evidence-against' ELSE 'evidence-for' END, '', 0.0e0, 0, '', 1.0e0 FROM nodes
    UNION ALL SELECT 'edge', concat(prefix, id, '>', CASE WHEN length(community_id) % 2 = 0 THEN concat('r', first) ELSE concat('c', first) END), 'community-member-of', '', 0.0e0, 0, '', 0.8e0 FROM (SELECT community_id, first, unnest(ids) AS id FROM (SELECT community_id, graph_id, min(id) AS first, list(id) AS ids FROM nodes GROUP BY ALL)) CROSS JOIN (SELECT 'e' AS prefix UNION ALL SELECT 'u')""", "nodes", "raw_edges")  # fmt: skip
def _(a: Analysis) -> DataFrame:
    n = a.corpus.nodes
    grouped = n.groupBy("community_id", "graph_id").agg(F.min("id").alias("first"), F.collect_list("id").alias("ids"))
    status = "get(array(" + ", ".join(f"'{s}'" for s in STATUS) + "), cast(g % 4 AS int))"
    tables = {
        "documents": n.selectExpr("id", "title", "text", "cast(year AS string) AS period"),
        "text_units": n.selectExpr("concat('u', id) AS id", "id AS document_id", "text", "cast(token_count AS int) AS n_tokens", "community_id", "concat(year, '-01-01T00:00:00.0Z') AS period"),
        "entities": n.selectExpr("concat('e', id) AS id", "title", "text AS description", "community_id"),
        "relationships": a.corpus.edges.selectExpr("source_id", "target_id", "confidence AS weight"),
        "community_reports": grouped.selectExpr("concat('r', first) AS id", "community_id AS community", "community_id AS title", "first AS summary", "0.5e0 AS rank"),
        "communities": grouped.selectExpr("concat('c', first) AS id", "transform(ids, i -> concat('e', i)) AS entity_ids", "transform(ids, i -> concat('u', i)) AS text_unit_ids", "CASE WHEN length(community_id) % 2 = 0 THEN concat('r', first) ELSE '' END AS report_id"),
        "covariates": n.selectExpr("concat('v', id) AS id", "concat('u', id) AS text_unit_id", "title AS claim", f"{status} AS status", "array(concat('u', id)) AS evidence_ids"),
    }
    nodes, edges = graphrag.mapped(tables)
    rows = nodes.selectExpr("'node' AS kind", "id", "chunk_type AS type", "title", "trust", "cast(token_count AS bigint) AS token_count", "coalesce(date_format(observed_at, 'yyyy'), '') AS observed_at", "0.0e0 AS confidence")
    return rows.unionByName(edges.selectExpr("'edge' AS kind", "concat(source_id, '>', target_id) AS id", "type", "'' AS title", "0.0e0 AS trust", "0L AS token_count", "'' AS observed_at", "confidence"))


@query("lightrag_import", f"""SELECT id, CASE WHEN g % 2 = 0 THEN 'lightrag-local' ELSE 'lightrag-global' END AS mode, CASE WHEN g % 2 = 0 THEN 'entity' ELSE 'community-summary' END AS chunk_type, {x.clamp('g % 15 / 10.0e0')} AS query_relevance FROM nodes""", "nodes")
def _(a: Analysis) -> DataFrame:
    n = a.corpus.nodes
    results = n.selectExpr("'q' AS query_id", "id AS node_id", "title", "text", "g % 15 / 10.0e0 AS score", "cast(1 AS int) AS rank", "community_id", "'' AS chunk_type", "g % 2 = 0 AS near")
    nodes, candidates = lightrag.mapped_results(results.where("near").drop("near"), results.where("NOT near").drop("near"))
    return candidates.join(nodes.select("id", "chunk_type"), candidates["node_id"] == nodes["id"]).select("id", F.col("retrieval_mode").alias("mode"), "chunk_type", "query_relevance")


def _rbac(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    roles = F.array(*(F.lit(r) for r in [*v.CLEARANCE_OF_ROLE, "guest"]))
    callers = events.select(F.col("user_id").cast("string").alias("caller_id"), F.get(roles, (F.col("event_id") % 7).cast("int")).alias("role"), F.lit("").alias("tenant_id"), F.array("event_type").alias("groups"))
    rows = access.contexts_from_roles(callers)
    return rows.groupBy(F.get("groups", F.lit(0)).alias("event_type"), F.col("caller_id").cast("long").alias("user_id"), "clearance").agg(F.count("*").alias("n"))


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centrality over a large graph: orders cite parts and belong to customers."""
    items, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    edges = items.selectExpr("0L AS graph_id", "cast(l_orderkey AS string) AS source_id", "concat('p', l_partkey) AS target_id", "'cites' AS type", "1.0e0 AS confidence", "'' AS note")
    edges = edges.unionByName(orders.selectExpr("0L AS graph_id", "cast(o_orderkey AS string) AS source_id", "concat('c', o_custkey) AS target_id", "'owned-by' AS type", "1.0e0 AS confidence", "'' AS note"))
    sums = graph.incident(graph.normalised_edges(edges)).groupBy("id").agg(F.expr("sum(CASE WHEN incoming THEN 1.0e0 ELSE 0.65e0 END * backlog_weight * confidence) AS raw"), F.count("*").alias("degree"))
    # One row: the largest sum.
    top = sums.agg(F.max("raw").alias("top"))
    return sums.join(F.broadcast(top)).selectExpr("id", f"{x.rounded('least(1.0e0, raw / top)', 6)} AS centrality", "degree")


RBAC_SQL = f"SELECT event_type, user_id, CASE event_id % 7 {' '.join(f'WHEN {i} THEN {x.quote(c)}' for i, c in enumerate(v.CLEARANCE_OF_ROLE.values()))} ELSE 'public' END AS clearance, count(*) AS n FROM events GROUP BY ALL"
STAR_SQL = """SELECT id, round(least(1.0e0, raw / max(raw) OVER ()) * 1000000.0e0) / 1000000.0e0 AS centrality, degree FROM (
    SELECT id, sum(w) AS raw, count(*) AS degree FROM (SELECT t AS id, w FROM star_edges UNION ALL SELECT s, 0.65e0 * w FROM star_edges) GROUP BY id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda s, d, run=run: run(analysis(s, d))) for name, (run, _, _) in _made.items()}
    return found | {"rbac_clearance": _rbac, "star_centrality": _star}


def oracle_sql() -> dict[str, str]:
    found = {name: oracles.sql(select, *needs) for name, (_, select, needs) in _made.items()}
    return found | {"rbac_clearance": RBAC_SQL, "star_centrality": oracles.sql(STAR_SQL, "star_edges"), "read_queue": oracles.read_queue()}
