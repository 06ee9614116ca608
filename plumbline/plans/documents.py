"""One request's results as JSON documents: route, rank, pack and hygiene.

A document holds one request, which is bounded; batches are written with the sinks instead.
Empty optional fields are left out, lists that nothing was put into are null, and a missing
time is the year 1.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import functions as F

from plumbline.operators import ranking, routing
from plumbline.plans.pipeline import Analysis
from plumbline.sources.sinks import NO_TIME, indented

# The fields of a node and of a reference in order, and whether an empty one is left out.
NODE_FIELDS = (
    ("id", False), ("title", False), ("authors", True), ("source", True), ("year", True), ("type", True), ("url", True), ("length_minutes", True),
    ("difficulty", True), ("status", True), ("topics", True), ("notes", True), ("goal_fit", True), ("energy", True), ("density", True),
    ("trust", True), ("recommended_count", True), ("text", False), ("chunk_type", False), ("token_count", False), ("version", False),
    ("sensitivity", False), ("embedding_model", True), ("approved_by", True), ("superseded_by", True), ("context_prefix", True),
    ("community_id", True), ("tenant_id", True), ("source_trail", True), ("origin", True), ("observed_at", False), ("updated_at", False),
    ("locator", False), ("semantic_type", True), ("attributes", True),
)
REF_FIELDS = (
    ("node_id", False), ("origin", False), ("source", False), ("url", True), ("version", False), ("observed_at", False), ("updated_at", False),
    ("locator", False), ("community_id", True),
)
TIMES = ("observed_at", "updated_at")


def plain(value: Any) -> Any:
    """Whole doubles as integers, times as text, structs without empty fields."""
    if isinstance(value, float):
        return int(value) if value.is_integer() else value
    if isinstance(value, datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%SZ")
    if isinstance(value, dict):
        return {k: plain(x) for k, x in value.items()}
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


def fields(row: dict, names: tuple[tuple[str, bool], ...]) -> dict:
    out = {}
    for name, optional in names:
        value = row.get(name)
        if name in TIMES:
            value = value or NO_TIME
        elif name == "locator":
            value = {k: x for k, x in (value or {}).items() if x}
        elif optional and not value:
            continue
        out[name] = plain("" if value is None else value)
    return out


def _nodes(a: Analysis, query_id: str) -> dict[str, dict]:
    own = a.corpus.queries.where(F.col("query_id") == query_id).select("graph_id")
    return {r["id"]: r.asDict(recursive=True) for r in a.corpus.nodes.join(own, "graph_id", "left_semi").collect()}


def _own_id(a: Analysis, query_id: str) -> str:
    """The id that the request came with."""
    q = a.corpus.queries
    return q.where(F.col("query_id") == query_id).select("request_id" if "request_id" in q.columns else "query_id").first()[0]


def route(a: Analysis, query_id: str) -> str:
    r = routing.routed(a.corpus.queries, a.metadata).where(F.col("query_id") == query_id).first()
    return indented({"query_type": r["query_type"], "retrieval_mode": r["mode"], "context_budget_hint": r["budget_hint"], "reasons": [r["reason"]], "counterpoint_required": r["counterpoint_required"]})


SCORE_FIELDS = {
    "total": "total", "query_relevance": "query_relevance", "graph_importance": "graph_importance", "authority_score": "authority", "readiness": "readiness", "freshness": "freshness", "token_budget_fit": "token_fit",
    "bridge_bonus": "bridge_bonus", "counterpoint_bonus": "counterpoint_bonus", "diversity_bonus": "diversity", "redundancy_penalty": "redundancy", "staleness_penalty": "staleness", "low_trust_penalty": "low_trust",
}


def rank(a: Analysis, query_id: str) -> str:
    nodes, own = _nodes(a, query_id), F.col("query_id") == query_id
    query = a.corpus.queries.where(own).select("query").first()["query"]
    ranked = []
    for r in a.ranked.where(own).withColumn("rationale", F.expr(ranking.rationale())).orderBy("rank").collect():
        score = {"node_id": r["id"]} | {k: plain(r[c]) for k, c in SCORE_FIELDS.items()} | {"role": r["role"], "access_allowed": True, "rationale": list(r["rationale"])}
        ranked.append({"node": fields(nodes[r["id"]], NODE_FIELDS), "candidate": {"node_id": r["id"], "query_relevance": plain(r["relevance"] or 0.0)}, "score": score})
    denied = []
    for r in a.rank_suppressed.where(own).orderBy("id").collect():
        denied.append({"node_id": r["id"]} | dict.fromkeys(SCORE_FIELDS, 0) | {"role": "", "access_allowed": False, "suppression_reason": r["reason"], "rationale": [r["detail"]]})
    return indented({"query_id": _own_id(a, query_id), "query": query, "ranked": ranked or None, "suppressed": denied or None})


def pack(a: Analysis, query_id: str) -> str:
    nodes, own = _nodes(a, query_id), F.col("query_id") == query_id
    plan = a.responses.where(own).first().asDict(recursive=True)
    whys = {r["id"]: r["why"] for r in a.slots.where(own).selectExpr("id", f"array_join({ranking.rationale()}, '; ') AS why").collect()}
    hops: dict[str, list[dict]] = {}
    for r in a.trails.where(own).orderBy("index", "place").collect():
        hops.setdefault(r["id"], []).append({"node_id": r["node_id"], "edge_type": r["edge_type"], "confidence": plain(r["confidence"])})
    slots = []
    for s in plan["slots"] or []:
        node = nodes[s["node_id"]]
        slots.append({
            "index": s["index"], "slot_type": s["slot_type"], "node_id": s["node_id"], "role": s["role"], "title": s["title"], "text": node["text"], "token_count": s["token_count"], "score": plain(s["score"]), "position": s["position"],
            "source": fields(node | {"node_id": node["id"]}, REF_FIELDS), "source_trail": hops[s["node_id"]], "must_cite": s["must_cite"], "rationale": whys[s["node_id"]],
        })
    gone = [{k: plain(x) for k, x in e.items() if x or k in ("node_id", "reason")} for e in plan["suppressed"] or []]
    out = {"query_id": _own_id(a, query_id), "query_type": plan["query_type"], "slots": slots or None, "suppressed": gone or None}
    if plan["suppressed_by_reason"]:
        out["suppressed_by_reason"] = dict(sorted(plan["suppressed_by_reason"].items()))
    trail = [h for s in slots for h in s["source_trail"]]
    out |= {"evidence_path": [s["node_id"] for s in slots] or None, "source_trail": trail or None, "critique_summary": plan["critique_summary"], "tokens_used": plan["tokens_used"], "hygiene_signal": plan["signal"]}
    return indented(out)


def hygiene(a: Analysis, query_id: str) -> str:
    r = a.hygiene.where(F.col("query_id") == query_id).first().asDict(recursive=True)
    edges = sorted(r["missing_edges"] or [], key=lambda e: (e["source_id"], e["target_id"], e["type"]))
    out = {"duplicate_clusters": r["duplicate_clusters"] or [], "orphan_nodes": r["orphan_nodes"] or None, "stale_nodes": r["stale_nodes"] or [], "missing_bridges": r["missing_bridges"] or None, "missing_edges": plain(edges) or None, "score": plain(r["score"]), "signal": r["signal"]}
    return indented(out | ({"retrieval_targets": r["retrieval_targets"]} if r["retrieval_targets"] else {}))


DOCUMENTS = {"route": route, "rank": rank, "pack": pack, "hygiene": hygiene}
