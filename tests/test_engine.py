"""Goldens and unit values of the context-assembly operators."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.functions import vocabulary as v
from plumbline.functions.expressions import SPARK
from plumbline.operators import access, graph, hygiene, memory, packing, ranking, routing
from plumbline.plans import backlog as backlog_plan
from plumbline.plans.pipeline import Analysis, validation_errors
from plumbline.sources import backlog, candidates, graphrag, lightrag, sinks

NODE = {"id": "policy", "title": "Refund Policy", "trust": 1, "goal_fit": 1, "text": "Refund policy text.", "chunk_type": "document", "version": "v1", "sensitivity": "internal"}


def one(spark, expression, **columns):
    row = spark.range(1).select(*(F.expr(e).alias(c) for c, e in columns.items())) if columns else spark.range(1)
    return row.selectExpr(f"{expression} AS r").first()["r"]


def analysis(spark, tmp_path, *requests):
    path = tmp_path / "requests.json"
    path.write_text("".join(json.dumps(r) + "\n" for r in requests))
    return Analysis(candidates.corpus(candidates.read_requests(spark, str(path)), 2026))


def request(**more):
    return {"query_id": "q", "query": "refund policy", "access": {"caller_id": "u", "clearance": "internal"}, "nodes": [NODE], "candidates": [{"node_id": "policy", "query_relevance": 1}]} | more


def test_golden_rank(spark, tmp_path):
    row = analysis(spark, tmp_path, request()).ranked.withColumn("why", F.expr(ranking.rationale())).first()
    assert (row["total"], round(row["authority"], 9), row["readiness"], row["freshness"], round(row["token_fit"], 9), row["diversity"], row["role"]) == (61.7, 0.57, 0.64, 0.65, 0.55, 1.0, "curiosity-leaf")
    assert row["why"] == ["query relevance 1.00", "authority 0.57", "graph importance 0.00", "token budget fit 0.55", "token count estimated as 5"]


def test_golden_pack_hygiene_and_route(spark, tmp_path):
    a = analysis(spark, tmp_path, request(token_budget=1200, allow_degraded_plan=True))
    plan = a.plans.first()
    (slot,) = plan["slots"]
    assert (slot["slot_type"], slot["score"], slot["position"], slot["must_cite"], slot["token_count"]) == ("support", 66.2, "middle", False, 5)
    assert [(h["edge_type"], h["confidence"]) for h in plan["source_trail"]] == [("retrieved", 1.0), ("slot-required", 0.662)]
    assert (plan["critique_summary"], plan["tokens_used"], plan["signal"], plan["evidence_path"]) == ("Packed 1 slots with red hygiene and 0 suppressions.", 5, "red", ["policy"])
    report = a.hygiene.first()
    assert (report["orphan_nodes"], report["score"], report["signal"], report["missing_edges"]) == (["policy"], 0.8200000000000001, "green", None)
    assert json.loads(sinks.hygiene_json(report.asDict(recursive=True)))["missing_bridges"] is None
    route = routing.routed(a.corpus.queries, a.metadata).first()
    assert (route["query_type"], route["mode"], route["budget_hint"], route["reason"]) == ("Factual", "HybridBM25Dense", 3000, "short query without entity match")
    assert a.responses.first()["status"] == "ok"


def test_denied_only_and_red_status(spark, tmp_path):
    secret = request(query_id="s", nodes=[NODE | {"sensitivity": "secret-plan"}])
    rows = {r["query_id"]: r for r in analysis(spark, tmp_path, request(), secret).responses.collect()}
    assert rows["s"]["status"] == "access-denied-only" and rows["q"]["status"] == "red-signal"
    assert "Refund policy text" not in json.dumps(rows["s"].asDict(recursive=True), default=str)


def test_last_candidate_counts_and_errors(spark, tmp_path):
    twice = request(candidates=[{"node_id": "policy", "query_relevance": 0.9}, {"node_id": "policy", "query_relevance": 0.2}])
    assert analysis(spark, tmp_path, twice).ranked.first()["query_relevance"] == 0.2
    bad = request(nodes=[NODE, NODE, NODE | {"id": " "}], edges=[{"source_id": "policy", "target_id": "gone"}], candidates=[{"node_id": "lost"}, {"node_id": ""}])
    found = {r["error"] for r in validation_errors(analysis(spark, tmp_path, bad).corpus).collect()}
    assert found == {"node is missing id", "duplicate node id", "edge target_id does not match any node", "candidate does not match any node", "candidate is missing node_id"}


@pytest.mark.parametrize(("raw", "kind"), [(" Requires ", "prerequisite"), ("approved_by", "approved-by"), ("in  community", "community-member-of"), ("", "related-to"), ("odd one", "related-to"), *v.EDGE_ALIASES.items()])
def test_edge_types(spark, raw, kind):
    edges = spark.createDataFrame([("g", "a", "b", raw, 1.0, "")], "graph_id string, source_id string, target_id string, type string, confidence double, note string")
    row = graph.normalised_edges(edges).first()
    assert (row["type"], row["weight"]) == (kind, v.EDGE_WEIGHTS[kind])
    assert row["note"] == ("" if raw in ("", kind) else f"raw_type={raw}")


def test_authority_and_token_values(spark):
    columns = dict(trust="0.5e0", cites="0.0e0", approved="0.0e0", chunk_type="'section'", version="''", superseded_by="''")
    value = lambda **more: one(spark, x.authority_parts(), **(columns | more))
    assert value() == pytest.approx(0.3375) and value(version="'v1'") == pytest.approx(0.3875)
    assert value(version="'v1'", superseded_by="'n2'") == pytest.approx(0.2875)
    assert value(trust="2.0e0", cites="1.0e0", approved="1.0e0", chunk_type="'permission-record'", version="'v3'") == 1
    fits = [one(spark, graph.token_fit("n", "100", f"{d}e0"), n=str(n)) for n, d in ((8, 1.0), (9, 1.0), (16, 1.0), (26, 1.0))]
    assert fits == pytest.approx([1.0, 0.88, 0.73, 0.55])


def test_total_formula_value(spark):
    parts = dict(query_relevance="1.0e0", authority="0.935e0", graph_importance="0.55e0", readiness="1.0e0", freshness="1.0e0", token_fit="1.0e0", diversity="1.0e0", bridge_bonus="0.0e0", counterpoint_bonus="0.0e0", redundancy="0.0e0", staleness="0.0e0", low_trust="0.0e0", query_type="''", role="'foundation'", chunk_type="'section'")
    want = 0.28 + 0.18 * 0.935 + 0.14 * 0.55 + 0.1 + 0.1 + 0.1 + 0.05
    total = x.total_score(x.positive(), x.negative(), x.modifier())
    assert one(spark, total, **parts) == round(want * 1000) / 10
    assert one(spark, total, **(parts | {"query_type": "'Factual'"})) == round(want * 1000) / 10 + 8
    assert one(spark, total, **(parts | {"low_trust": "1.0e0", "query_type": "'Adversarial'"})) == pytest.approx(round((want - 0.16) * 1000) / 10)


@pytest.mark.parametrize("clearance", ["", "public", "internal", "confidential", "restricted", "odd"])
@pytest.mark.parametrize("sensitivity", ["", "public", "internal", "confidential", "restricted", "odd"])
def test_access_lattice(spark, clearance, sensitivity):
    columns = dict(tenant_id="''", caller_tenant="''", sensitivity=f"'{sensitivity}'", clearance=f"'{clearance}'", approved_by="cast(array() AS array<string>)", trusted_approvers="cast(array() AS array<string>)", chunk_type="'section'", allow_unapproved="false")
    level = {"public": 0, "": 1, "internal": 1, "confidential": 2, "restricted": 3}
    got = one(spark, x.denial(SPARK), **columns)
    assert (got is None) == (level.get(sensitivity, 3) <= level.get(clearance, 0))
    if got:
        assert got == f'node sensitivity "{sensitivity}" exceeds caller clearance "{clearance}"'


def test_access_approval_rules(spark):
    columns = dict(tenant_id="''", caller_tenant="''", sensitivity="'confidential'", clearance="'restricted'", approved_by="array('ops')", trusted_approvers="array('legal')", chunk_type="'procedure'", allow_unapproved="false")
    denial = lambda **more: one(spark, x.denial(SPARK), **(columns | more))
    assert denial() == "confidential or restricted node lacks a trusted approver for caller"
    assert denial(trusted_approvers="array('ops')") is None
    assert denial(approved_by="cast(array() AS array<string>)") == "procedure node lacks required approval"
    assert denial(approved_by="cast(array() AS array<string>)", allow_unapproved="true") is None
    assert denial(tenant_id="'acme'") == 'node tenant "acme" does not match caller tenant'


def test_roles_to_contexts(spark):
    rows = spark.createDataFrame([("u", "operator", "t1", ["g"]), ("w", "guest", "", [])], "caller_id string, role string, tenant_id string, groups array<string>")
    got = {r["caller_id"]: r for r in access.contexts_from_roles(rows).collect()}
    assert (got["u"]["clearance"], got["u"]["groups"], got["u"]["trusted_approvers"]) == ("confidential", ["t1", "g"], ["t1"])
    assert got["w"]["clearance"] == "public"


PPR_CASES = {
    "one edge": ([("a", "b", "cites", 0.0)], {"a": 1.0}),
    "cycle": ([("a", "b", "cites", 1.0), ("b", "c", "cites", 1.0), ("c", "a", "cites", 1.0)], {"a": 1.0}),
    "dangling": ([("a", "b", "cites", 0.0), ("b", "a", "cites", 0.0)], {"a": 1.0, "c": 1.0}),
}


@pytest.mark.parametrize("case", PPR_CASES)
def test_personalised_pagerank(spark, case):
    edges, seeds = PPR_CASES[case]
    nodes = spark.createDataFrame([("q", i, seeds.get(i, 0.0)) for i in "abc"], "query_id string, id string, seed double")
    table = spark.createDataFrame([("g", *e, "") for e in edges], "graph_id string, source_id string, target_id string, type string, confidence double, note string")
    queries = spark.createDataFrame([("q", "g")], "query_id string, graph_id string")
    got = {r["id"]: r["ppr"] for r in graph.personalised_pagerank(nodes, graph.normalised_edges(table), queries).collect()}
    if case == "one edge":
        assert set(got.values()) == {0.0}
    else:
        assert sum(got.values()) == pytest.approx(1, abs=1e-6)
    if case == "cycle":
        assert got["a"] > got["b"] > got["c"]
    if case == "dangling":
        assert got["c"] > 0


@pytest.mark.parametrize(
    ("query", "meta", "want"),
    [
        ("approve refund for account", {"perm": True}, ("Agentic", "DRIFTChain", 6000)),
        ("latest vendor access version", {}, ("Temporal", "HybridBM25Dense", 4500)),
        ("how do I troubleshoot login", {}, ("Procedural", "LocalNeighborhood", 5000)),
        ("compare postgres versus mysql", {}, ("Comparative", "DRIFTChain", 5500)),
        ("is it safe to grant access", {}, ("Adversarial", "DRIFTChain", 6000)),
        ("status for account A", {"entities": ["account A"]}, ("Factual", "LocalNeighborhood", 3500)),
        ("what are the themes in refunds", {}, ("Exploratory", "GlobalGraph", 6500)),
        ("explain refunds", {"span": 4}, ("Exploratory", "GlobalGraph", 6500)),
        ("refund policy", {}, ("Factual", "HybridBM25Dense", 3000)),
        ("tell me everything relevant about the customer support refund knowledge base", {}, ("Factual", "HybridBM25Dense", 4000)),
        ("rules of 1999", {}, ("Temporal", "HybridBM25Dense", 4500)),
    ],
)
def test_routes(spark, query, meta, want):
    queries = spark.createDataFrame([("q", query)], "query_id string, query string")
    table = spark.createDataFrame([("q", meta.get("entities", []), meta.get("perm", False), False, meta.get("span", 0))], "query_id string, entity_ids array<string>, has_permission boolean, has_decision_basis boolean, topic_span int")
    row = routing.routed(queries, table).first()
    assert (row["query_type"], row["mode"], row["budget_hint"]) == want
    assert row["counterpoint_required"] == (want[0] == "Adversarial")


def packed(spark, rows, query_type, budget):
    """rows: id, slot type, score, tokens, through the ordering and trimming."""
    table = spark.createDataFrame([("q", i, s, float(t), n, query_type, budget, None) for i, s, t, n in rows], "query_id string, id string, slot_type string, total double, tokens long, query_type string, budget int, reason string")
    out = packing.trimmed(table)
    return [r["id"] for r in out.where("NOT trimmed").orderBy("index").collect()], {r["id"] for r in out.where("trimmed").collect()}


def test_order_and_trim(spark):
    agentic = [("procedure", "procedure", 100, 10), ("permission", "permission", 100, 10), ("foundation", "foundation", 100, 10), ("counter", "counterpoint", 100, 10), ("overview", "overview", 100, 10)]
    assert packed(spark, agentic, "Agentic", 1000)[0] == ["permission", "foundation", "procedure", "overview", "counter"]
    assert packed(spark, [("b", "overview", 50, 10), ("a", "overview", 50, 10), ("c", "overview", 60, 10)], "Factual", 1000)[0] == ["c", "a", "b"]
    trim = [("foundation", "foundation", 90, 50), ("support", "support", 10, 30), ("overview", "overview", 20, 30), ("bridge", "bridge", 30, 30)]
    assert packed(spark, trim, "Factual", 80) == (["foundation", "bridge"], {"support", "overview"})
    assert packed(spark, [("foundation", "foundation", 90, 120)], "Factual", 100) == (["foundation"], set())


BACKLOG_ITEMS = [
    ("classic", "Classic Foundations of Urban Heat Islands", 1998, "book", ["urban", "climate"], 80, 2, 0.80, "", 0),
    ("review", "A Review and Primer on Urban Tree Cooling", 2023, "review", ["urban", "trees", "cooling"], 35, 2, 0.95, "medium", 0),
    ("bridge", "From Street Design to Canopy Equity", 2022, "article", ["urban", "trees", "equity"], 45, 2, 0.75, "", 0),
    ("counter", "Counterpoint: Shade Claims Overstate Benefits", 2021, "article", ["cooling"], 30, 3, 0.55, "", 0),
    ("hype", "Hot Trend Breakthrough App for City Trees", 2017, "newsletter", ["trees"], 20, 1, 0.35, "", 4),
    ("leaf", "A Curious History of Park Benches", 2020, "essay", ["benches"], 20, 1, 0.10, "", 0),
    ("dupe1", "Urban Tree Cooling Primer", 2023, "article", ["trees", "cooling"], 25, 1, 0.8, "", 0),
    ("dupe2", "The Urban Tree Cooling Primer", 2023, "article", ["trees", "cooling"], 25, 1, 0.8, "", 0),
    ("advanced", "Advanced Boundary Layer Model", 2024, "paper", ["urban", "physics"], 120, 5, 0.7, "", 0),
]
BACKLOG_EDGES = [("classic", "advanced", "prerequisite"), ("review", "classic", "cites"), ("bridge", "classic", "cites"), ("bridge", "counter", "contradicts"), ("review", "advanced", "overview"), ("dupe1", "dupe2", "duplicate"), ("gone", "leaf", "cites")]


@pytest.fixture(scope="module")
def reading(spark):
    items = spark.createDataFrame([(*i, k) for k, i in enumerate(BACKLOG_ITEMS)], "id string, title string, year int, type string, topics array<string>, length_minutes int, difficulty int, goal_fit double, energy string, recommended_count int, pos int")
    for c in ("source", "url", "status", "notes", "density"):
        items = items.withColumn(c, F.lit("unread" if c == "status" else ""))
    items = items.withColumn("trust", F.lit(0.0)).withColumn("authors", F.array().cast("array<string>"))
    edges = spark.createDataFrame([(*e, 0.0, "") for e in BACKLOG_EDGES], "source_id string, target_id string, type string, confidence double, note string")
    goal = {"prompt": "urban trees cooling", "topics": ["urban", "trees", "cooling"], "familiarity": 2, "energy": "medium", "time_minutes": 150}
    return backlog_plan.analysed(items, edges, goal, 2026)


def test_backlog_roles(reading):
    rows, _ = reading
    roles = {r["id"]: r["role"] for r in rows.collect()}
    want = {"classic": "foundation", "review": "overview", "bridge": "bridge", "counter": "counterpoint", "hype": "stale-hype", "leaf": "curiosity-leaf", "dupe1": "duplicate", "dupe2": "duplicate"}
    assert {k: roles[k] for k in want} == want


def test_backlog_queue_and_report(reading):
    rows, edges = reading
    queue = ranking.reading_queue(rows, 60, 3).orderBy("place").collect()
    taken = [r for r in queue if r["chosen"]]
    used, n = 0, 0
    for r in queue:
        fits = n < 3 and (used + r["minutes"] <= 60 or n == 0)
        assert r["chosen"] == fits
        used, n = (used + r["minutes"], n + 1) if fits else (used, n)
    assert taken and sinks.queue_lines(rows, 60, 3).count() == len(queue)
    report = backlog_plan.report(rows, edges)
    assert report["duplicate_clusters"] == [["dupe1", "dupe2"]] and set(report["orphan_nodes"]) == {"hype", "leaf"} and report["stale_nodes"] == ["hype"]
    assert "[dupe1, dupe2]" in sinks.hygiene_text(report)


def test_backlog_files(spark, tmp_path):
    csv = tmp_path / "b.csv"
    csv.write_text("record_type,id,title,year,type,topics,source_id,target_id,edge_type\nitem,a,Primer,2024,review,trees; city,,,\nitem,b,Deep Paper,bad,paper,cooling,,,\nedge,,,,,,a,b,mentions\n")
    items, edges = backlog.read(spark, str(csv))
    got = {r["id"]: r for r in items.collect()}
    assert (got["a"]["topics"], got["b"]["year"], got["b"]["difficulty"], got["a"]["length_minutes"]) == (["trees", "city"], 0, 3, 45)
    assert [(e["type"], e["confidence"]) for e in edges.collect()] == [("cites", 1.0)]
    doc = tmp_path / "b.json"
    doc.write_text('{"items":[{"id":"low","title":"Low","difficulty":-4,"trust":-0.5},{"title":"The High and very long title that goes on","difficulty":8,"trust":1.7}]}')
    got = [(r["id"], r["difficulty"], r["trust"]) for r in backlog.read(spark, str(doc))[0].collect()]
    assert got == [("low", 1, 0.0), ("high-very-long-title-that-go-2", 5, 1.0)]
    doc.write_text('[{"id":"x","title":"X"}]')
    assert backlog.read(spark, str(doc))[0].first()["id"] == "x"
    (tmp_path / "e.csv").write_text("  ")
    with pytest.raises(ValueError):
        backlog.read(spark, str(tmp_path / "e.csv"))


EXPORT = {
    "query_id": "q-graph", "query": "summarize vendor access",
    "documents": [{"id": "doc-1", "human_readable_id": "DOC1", "title": "Vendor Access Policy", "text": "Policy text", "period": "2026-05-01"}],
    "text_units": [{"id": "tu-1", "document_id": "doc-1", "text": "Vendor access detail", "n_tokens": 12, "community_id": "c1"}],
    "entities": [{"id": "entity-1", "title": "Vendor", "description": "External vendor", "community_id": "c1"}],
    "relationships": [{"source_id": "entity-1", "target_id": "tu-1", "weight": 0.7, "description": "entity appears in text"}],
    "community_reports": [{"id": "report-c1", "community": "c1", "title": "Vendor Access Community", "summary": "Vendor access overview", "rank": 0.91, "period": "2026"}],
    "communities": [{"id": "c1", "report_id": "report-c1", "entity_ids": ["entity-1"], "text_unit_ids": ["tu-1"]}],
    "covariates": [{"id": "claim-1", "claim": "Vendors require approval", "status": "disputed", "evidence_ids": ["tu-1"], "period": "2026-05-01"}],
}


def test_graph_export(spark, tmp_path):
    path = tmp_path / "export.json"
    path.write_text(json.dumps(EXPORT))
    query, nodes, edges = graphrag.read_json(spark, str(path))
    got = {r["id"]: r for r in nodes.collect()}
    assert query.first()["query_id"] == "q-graph" and len(got) == 5 and edges.count() == 4
    assert got["report-c1"]["text"] == "Vendor access overview" and got["report-c1"]["attributes"]["community_report_rank"] == "0.91"
    assert str(got["report-c1"]["observed_at"]) == "2026-01-01 00:00:00" and got["tu-1"]["token_count"] == 12
    assert {(e["type"], e["confidence"]) for e in edges.collect()} == {("evidence-against", 1.0), ("related-to", 0.7), ("community-member-of", 0.8)}


def test_two_level_handoff(spark, tmp_path):
    path = tmp_path / "handoff.json"
    path.write_text(json.dumps({"query_id": "q", "query": "x", "local_results": [{"node_id": "a", "title": "A", "score": 1.4, "rank": 1}], "global_results": [{"node_id": "b", "title": "B", "score": 0.5, "rank": 2, "chunk_type": "claim"}], "relationships": [{"source_id": "a", "target_id": "b", "type": "mentions", "confidence": 0.5}]}))
    _, nodes, edges, found = lightrag.read_json(spark, str(path))
    assert {(r["id"], r["chunk_type"]) for r in nodes.collect()} == {("a", "entity"), ("b", "claim")}
    assert edges.first()["type"] == "cites"
    assert {(r["node_id"], r["query_relevance"], r["retrieval_mode"]) for r in found.collect()} == {("a", 1.0, "lightrag-local"), ("b", 0.5, "lightrag-global")}


def test_missing_edge_rules(spark):
    names = [("policy", "Refund Policy", ["refund", "policy"], "c1", "section", ""), ("exception", "Refund Exception", ["refund", "policy"], "c1", "section", ""), ("summary", "Refund Summary", ["refund"], "c1", "community-summary", ""), ("dupe-a", "Vendor Access Policy", [], "c2", "section", ""), ("dupe-b", "Vendor Access Policy", [], "c3", "section", ""), ("old", "Old Runbook", [], "c4", "procedure", "new"), ("new", "New Runbook", [], "c4", "procedure", "")]
    nodes = candidates.filled_nodes(spark.createDataFrame([("g", *n) for n in names], "graph_id string, id string, title string, topics array<string>, community_id string, chunk_type string, superseded_by string"))
    none = spark.createDataFrame([], "graph_id string, source_id string, target_id string, type string, confidence double, note string")
    got = {(r["source_id"], r["target_id"], r["type"], r["confidence"]) for r in hygiene.missing_edges(nodes, graph.normalised_edges(none)).collect()}
    assert {("exception", "policy", "same-question", 0.7), ("exception", "policy", "exception-to", 0.55), ("policy", "summary", "community-member-of", 0.8), ("dupe-a", "dupe-b", "duplicate", 0.9), ("new", "old", "supersedes", 1.0)} <= got


SLOT = "index: int, node_id: string, version: string, community_id: string, token_count: bigint, text: string"
CLEAR = {"clearance": "restricted"}


def memory_plans(spark, *more):
    slots = [(0, "n1", "v1", "Topic-A", 10, "first text"), (1, "n2", "v2", "topic-b", 20, "second text")]
    other = [(0, "n1", "v1", "elsewhere", 10, ""), (1, "n2", "v2", "other", 20, "")]
    rows = [("q1", "Factual", "green", slots), ("q2", "Factual", "red", slots), ("q3", "Procedural", "green", other), *more]
    return spark.createDataFrame(rows, f"query_id string, query_type string, signal string, slots array<struct<{SLOT}>>")


def current(spark, **changes):
    """n1 and n2 as they are now."""
    base = {"version": "", "sensitivity": "internal", "superseded_by": ""}
    rows = [(i, *({**base, "version": v} | changes.get(i, {})).values()) for i, v in (("n1", "v1"), ("n2", "v2"))]
    return candidates.filled_nodes(spark.createDataFrame(rows, "id string, version string, sensitivity string, superseded_by string"))


def test_memory_stores_whole_plans(spark, tmp_path):
    path, plans = str(tmp_path / "memory"), memory_plans(spark)
    assert memory.load(spark, path).count() == 0
    memory.store(plans, path, "2026-01-01T00:00:00Z", 1)
    memory.store(plans, path, "2026-01-02T00:00:00Z", 2)
    stored = memory.load(spark, path)
    assert stored.count() == 4 and stored.where("signal = 'red'").count() == 0
    plan = memory.newest(stored).where("query_id = 'q1'").first()
    assert (plan["seq"], plan["created_at"], plan["topics"], plan["evidence_path"], plan["tokens_used"], plan["node_versions"]) == (2, "2026-01-02T00:00:00Z", ["topic-a", "topic-b"], ["n1", "n2"], 30, {"n1": "v1", "n2": "v2"})
    assert [s["text"] for s in plan["slots"]] == ["first text", "second text"] and plan["plan_hash"].startswith("sha256:")
    memory.save(spark, path, "session", plans.where("query_id = 'q1'"), "2026-01-03T00:00:00Z", 3)
    memory.save(spark, path, "session", plans.where("query_id = 'q1'"), "2026-01-04T00:00:00Z", 4)
    rows = memory.session(spark, path, "session", current(spark), CLEAR).collect()
    assert [(r["plan_query_id"], r["seq"]) for r in rows] == [("q1", 4)] and memory.load(spark, path).count() == 5
    memory.delete(spark, path, "q1")
    assert sorted(r["query_id"] for r in memory.load(spark, path).collect()) == ["q3", "q3", "session"]


def test_memory_survives_a_broken_replacement(spark, tmp_path):
    """What a job left without its success file is no version; the old one stays."""
    path = tmp_path / "memory"
    memory.store(memory_plans(spark), str(path), "2026-01-01T00:00:00Z", 1)
    (path / "v=2").mkdir()
    (path / "v=2/part-0.json").write_text('{"query_id":')
    assert memory.load(spark, str(path)).count() == 2
    memory.delete(spark, str(path), "q3")
    assert [r["query_id"] for r in memory.load(spark, str(path)).collect()] == ["q1"]


def test_memory_gates_again(spark):
    stored, secret = memory.records(memory_plans(spark), "2026-01-01T00:00:00Z"), current(spark, n2={"sensitivity": "restricted"})
    plan = memory.prior(stored, secret, {"clearance": "internal"}).where("query_id = 'q1'").first()
    assert [(s["index"], s["node_id"]) for s in plan["slots"]] == [(0, "n1")] and (plan["evidence_path"], plan["tokens_used"], plan["n_stored"]) == (["n1"], 10, 2)
    assert [(e["node_id"], e["reason"]) for e in plan["suppressed"]] == [("n2", "access-control")] and "second text" not in json.dumps(plan.asDict(recursive=True))
    seen = lambda topics, nodes, caller: [[s["node_id"] for s in r["slots"]] for r in memory.similar(stored, topics, nodes, caller).collect()]
    assert seen(["topic-a", "TOPIC-B "], current(spark), CLEAR) == [["n1", "n2"]]
    # Without the slot that may not be seen, the topics are no longer alike enough.
    assert seen(["topic-a", "topic-b"], secret, {"clearance": "internal"}) == []
    assert seen(["topic-a", "topic-b"], current(spark, n1={"superseded_by": "n9"}), CLEAR) == []


def test_memory_of_several_graphs(spark):
    """One id in two graphs: a plan meets the node of its own."""
    stored = memory.records(memory_plans(spark).where("query_id = 'q1'").withColumn("graph_id", F.lit("g1")), "2026-01-01T00:00:00Z")
    nodes = current(spark).withColumn("graph_id", F.lit("g1")).unionByName(current(spark, n1={"sensitivity": "restricted"}).withColumn("graph_id", F.lit("g2")))
    assert [s["node_id"] for s in memory.prior(stored, nodes, {"clearance": "internal"}).first()["slots"]] == ["n1", "n2"]


@pytest.mark.parametrize(
    ("topics", "kind", "changes", "clearance", "reason"),
    [
        (["topic-a", "topic-b"], "Temporal", {}, "restricted", "query-type"),
        (["topic-a"], "Agentic", {}, "restricted", "topic-mismatch"),
        (["topic-a", "topic-b"], "Agentic", {"n2": {"version": "v3"}, "n1": {"superseded_by": "n9"}}, "restricted", "superseded"),
        (["topic-a", "topic-b"], "Factual", {"n1": {"version": "v9", "superseded_by": "n9"}}, "restricted", "version-mismatch"),
        (["topic-a", "topic-b"], "Factual", {"n2": {"sensitivity": "restricted"}}, "internal", "access-control"),
        (["topic-a", "topic-b"], "Factual", {}, "internal", None),
    ],
)
def test_memory_reuse(spark, topics, kind, changes, clearance, reason):
    stored = memory.records(memory_plans(spark), "2026-01-01T00:00:00Z")
    asked = spark.createDataFrame([("q1", topics, kind)], "query_id string, topics array<string>, query_type string")
    assert memory.rejections(stored, asked, current(spark, **changes), {"clearance": clearance}).first()["reason"] == reason


def test_two_decimals_are_those_of_the_binary_value(spark):
    import random

    rng = random.Random(4)
    values = [0.0, 0.125, 0.375, 0.005, 0.015, 0.565, 0.345, 0.675, 1.0, 0.995, 12.5, 99.995, *(rng.randrange(2000) / 1000 for _ in range(500)), *(rng.random() * 3 for _ in range(500))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("v", f"{x.two_decimals('v')} AS s").collect()
    assert all(r["s"] == f"{r['v']:.2f}" for r in rows)


def test_clusters_in_one_task_and_in_rounds(spark, monkeypatch):
    import random

    rng = random.Random(3)
    nodes = candidates.filled_nodes(spark.createDataFrame([(g, f"n{i}", rng.choice(["", f"one two three four five six seven w{i % 9}", f"alone number {i} {g}"])) for g in ("g", "h") for i in range(60)], "graph_id string, id string, title string"))
    edges = graph.normalised_edges(spark.createDataFrame([("g", f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", "duplicate", 1.0, "") for _ in range(25)], "graph_id string, source_id string, target_id string, type string, confidence double, note string"))
    found = []
    for most in (500_000, 0):
        monkeypatch.setattr(graph, "TASK_LINKS", most)
        found.append(sorted(map(tuple, graph.duplicate_clusters(nodes, edges).select("graph_id", "id", "cluster").collect())))
    assert found[0] == found[1] and len(found[0]) > 40
    pairs = {(r["graph_id"], r["a"], r["b"]) for r in graph.similar_titles(nodes, x.title_words("title", SPARK)).collect()}
    sets = {(r["graph_id"], r["id"]): set(r["w"]) for r in nodes.selectExpr("graph_id", "id", f"{x.title_words('title', SPARK)} AS w").collect()}
    want = {(g, a, b) for (g, a), s in sets.items() for (h, b), t in sets.items() if g == h and a < b and s and t and len(s & t) / len(s | t) >= 0.88}
    assert pairs == want and want


def test_slug_keeps_whole_characters(spark):
    for title, want in (("Überblick über Märkte und Strömungen", "überblick-über-märkte-und-1"), ("Ää" * 20, "ää" * 7 + "-1"), ("日本語の長い長い題名", "日本語の長い長い題-1"), ("!!", "item-1")):
        got = one(spark, backlog.slug(), title=f"'{title}'", place="1")
        assert got == want and len(got.encode()) <= backlog.SLUG_BYTES + 2


def test_places_without_a_global_order(spark):
    rows = spark.range(1000).repartition(7).selectExpr("cast(id AS string) AS title", "id * 4000001 AS pos")
    got = backlog.placed(rows).collect()
    assert sorted(r["place"] for r in got) == list(range(1, 1001)) and all(r["place"] == int(r["title"]) + 1 for r in got)


@pytest.mark.parametrize(("text", "want"), [("2024-01-02T03:04:05.5Z", "2024-01-02 03:04:05.500000"), ("2024-01-02T03:04:05+01:00", "2024-01-02 02:04:05"), ("2024-01-02", "2024-01-02 00:00:00"), ("2024-03", "2024-03-01 00:00:00"), ("2024", "2024-01-01 00:00:00"), ("", "None"), ("soon", "None")])
def test_periods(spark, text, want):
    assert str(one(spark, graphrag.period("p"), p=f"'{text}'")) == want


def test_requests_with_one_id_stay_apart(spark, tmp_path):
    """Without an id, or with that of another, a request keeps its own graph and caller."""
    secret = {"nodes": [NODE | {"sensitivity": "restricted"}], "access": {"caller_id": "r", "clearance": "restricted"}}
    low = request(allow_degraded_plan=True)
    path = tmp_path / "requests.json"
    nameless = [{k: v for k, v in r.items() if k != "query_id"} for r in (low, low | secret)]
    path.write_text("".join(json.dumps(r) + "\n" for r in [*nameless, low, low | secret, low | {"query_id": "alone"}]) + '{"query_id": "broken", \n')
    corpus = candidates.corpus(candidates.read_requests(spark, str(path)), 2026)
    assert corpus.queries.count() == 5 and corpus.queries.select("query_id").distinct().count() == 5
    assert [r["record"] for r in corpus.corrupt.collect()] == ['{"query_id": "broken", ']
    a = Analysis(corpus)
    rows = a.responses.collect()
    assert sorted(r["request_id"] for r in rows) == ["", "", "alone", "q", "q"] and "alone" in {r["query_id"] for r in rows}
    assert all(r["status"] == "ok" and r["evidence_path"] == ["policy"] for r in rows) and a.rank_rows.count() == 5
    # The hash is that of the request's own id.
    assert len({r["plan_hash"] for r in rows if r["request_id"] == "q"}) == 1


def test_invalid_requests_have_no_plan(spark, tmp_path):
    lost = request(query_id="lost", candidates=[{"node_id": "policy", "query_relevance": 1}, {"node_id": "gone"}])
    loose = request(query_id="loose", edges=[{"source_id": "policy", "target_id": "gone", "type": "cites"}])
    rows = {r["query_id"]: r for r in analysis(spark, tmp_path, lost, loose, request(allow_degraded_plan=True)).responses.collect()}
    assert [(rows[q]["status"], rows[q]["error"]) for q in ("lost", "loose", "q")] == [("invalid-candidates", "candidate does not match any node"), ("invalid-candidates", "edge target_id does not match any node"), ("ok", None)]
    assert rows["lost"]["slots"] is None and rows["lost"]["plan_hash"] is None and rows["q"]["slots"]


def test_entry_without_the_tokenizers(monkeypatch):
    """A dependency that is missing costs its own queries only."""
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    for name in [m for m in sys.modules if m.startswith("plumbline.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    found = __spark_entry__.queries()
    assert "pack_plan" in found and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_stream_of_requests(spark, tmp_path):
    from plumbline.streaming import batches

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(json.dumps(request(allow_degraded_plan=True)) + "\n")
    batches.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 2026).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).first()["status"] == "ok"


def scattered(spark, n=60):
    """Nodes of two graphs, some ids twice (with one title), and edges among them of the types that rules look for."""
    import random

    rng = random.Random(5)
    names, links = [], []
    for g in ("g", "h"):
        for i in range(n):
            title = rng.choice(["Refund Policy", "Refund Exception", "Policy Exception", "Vendor Access Rules", f"Lone Page {i}"])
            title = title if i < n - 4 else next(t for h, k, t, *_ in names if (h, k) == (g, f"n{i % (n - 4):02}"))
            topics = rng.choice([[], ["refund"], ["Refund ", "policy"], ["policy", "refund", "audit"], [f"own {i}"]])
            kind = "community-summary" if rng.random() < 0.1 else "section"
            names.append((g, f"n{i % (n - 4):02}", title, topics, rng.choice(["", "c1", "c2", f"alone {i}"]), kind, rng.choice(["", "", f"n{(i + 1) % n:02}"])))
        for kind in ("same-question", "duplicate", "community-member-of", "exception-to", "supersedes"):
            links += [(g, f"n{a:02}", f"n{b:02}", kind, 1.0, "") for a in range(n) for b in range(n) if rng.random() < (0.9 if a % 3 else 0.1)]
    nodes = candidates.filled_nodes(spark.createDataFrame(names, "graph_id string, id string, title string, topics array<string>, community_id string, chunk_type string, superseded_by string"))
    edges = spark.createDataFrame(links, "graph_id string, source_id string, target_id string, type string, confidence double, note string")
    return nodes, graph.cut(graph.normalised_edges(edges))


def test_missing_ends_without_pairs(spark):
    """The ends of all missing edges, though no pair is made of them."""
    nodes, edges = scattered(spark)
    pairs = hygiene.missing_edges(nodes, edges).collect()
    assert len({r["type"] for r in pairs}) == 5
    got = [tuple(r) for r in hygiene.missing_ends(nodes, edges).select("graph_id", "id").collect()]
    assert len(got) == len(set(got)) and set(got) == {(r["graph_id"], r[e]) for r in pairs for e in ("source_id", "target_id")}
    assert len(got) < nodes.select("graph_id", "id").distinct().count()
    queries = spark.createDataFrame([("q", "g", False), ("r", "g", True), ("s", "h", False)], "query_id string, graph_id string, allow_degraded boolean")
    flags = hygiene.graph_flags(graph.standing(graph.cues(nodes, 2026), edges, 2026), edges)
    found = {tuple(r) for r in hygiene.retrieval_targets(queries, flags, hygiene.missing_ends(nodes, edges), threshold=1.0).collect()}
    bridges = {(r["graph_id"], r["id"]) for r in flags.where("missing_bridge").collect()}
    assert found == {(q, i) for q, g in (("q", "g"), ("s", "h")) for h, i in set(got) | bridges if h == g}


def test_missing_edges_by_brute_force(spark):
    """Every pair of rows that a rule names, ids that occur twice included; no pair meets the edges in a join."""
    nodes, edges = scattered(spark)
    rows = [(r, {t.strip().lower() for t in r["topics"]}, set(r["title"].lower().split())) for r in nodes.collect()]
    have = {tuple(r) for r in edges.select("graph_id", "source_id", "target_id", "type").collect()}
    want = []
    for a, ta, wa in rows:
        for b, tb, wb in rows:
            g, s, t = a["graph_id"], a["id"], b["id"]
            lacks = lambda kind, *ends: all((g, *e, kind) not in have for e in ends)  # noqa: E731, B023
            if g != b["graph_id"]:
                continue
            mates = a["community_id"] == b["community_id"] != ""
            if mates and s < t and ta and tb and len(ta & tb) / min(len(ta), len(tb)) >= 0.6 and lacks("same-question", (s, t), (t, s)):
                want.append((g, s, t, "same-question"))
            if s < t and len(wa & wb) / len(wa | wb) >= 0.88 and lacks("duplicate", (s, t), (t, s)):
                want.append((g, s, t, "duplicate"))
            if mates and s != t and b["chunk_type"] == "community-summary" and lacks("community-member-of", (s, t)):
                want.append((g, s, t, "community-member-of"))
            if s != t and "exception" in a["title"].lower() and "policy" in b["title"].lower() and lacks("exception-to", (s, t)):
                want.append((g, s, t, "exception-to"))
            if s != t and b["superseded_by"] == s and lacks("supersedes", (t, s)):
                want.append((g, s, t, "supersedes"))
    found = hygiene.missing_edges(nodes, edges)
    got = sorted(tuple(r) for r in found.select("graph_id", "source_id", "target_id", "type").collect())
    assert got == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1  # of superseded nodes
