"""The JSON documents of one request, byte for byte."""

import io
import json

import pytest

from plumbline.__main__ import main

REQUEST = {
    "query_id": "q-api-pack",
    "query": "refund policy",
    "token_budget": 1200,
    "access": {"caller_id": "user-1", "clearance": "internal"},
    "nodes": [{"id": "policy", "title": "Refund Policy", "trust": 1, "goal_fit": 1, "text": "Refund policy text.", "chunk_type": "document", "version": "v1", "sensitivity": "internal"}],
    "candidates": [{"node_id": "policy", "query_relevance": 1}],
}
HOPS = [{"node_id": "policy", "edge_type": "retrieved", "confidence": 1}, {"node_id": "policy", "edge_type": "slot-required", "confidence": 0.662}]
TIMES = {"observed_at": "0001-01-01T00:00:00Z", "updated_at": "0001-01-01T00:00:00Z", "locator": {}}
WANT = {
    "route": {"query_type": "Factual", "retrieval_mode": "HybridBM25Dense", "context_budget_hint": 3000, "reasons": ["short query without entity match"], "counterpoint_required": False},
    "hygiene": {"duplicate_clusters": [], "orphan_nodes": ["policy"], "stale_nodes": [], "missing_bridges": None, "missing_edges": None, "score": 0.8200000000000001, "signal": "green"},
    "rank": {
        "query_id": "q-api-pack", "query": "refund policy",
        "ranked": [{
            "node": {"id": "policy", "title": "Refund Policy", "goal_fit": 1, "trust": 1, "text": "Refund policy text.", "chunk_type": "document", "token_count": 0, "version": "v1", "sensitivity": "internal", **TIMES},
            "candidate": {"node_id": "policy", "query_relevance": 1},
            "score": {
                "node_id": "policy", "total": 61.7, "query_relevance": 1, "graph_importance": 0, "authority_score": 0.57, "readiness": 0.64, "freshness": 0.65, "token_budget_fit": 0.55, "bridge_bonus": 0, "counterpoint_bonus": 0, "diversity_bonus": 1,
                "redundancy_penalty": 0, "staleness_penalty": 0, "low_trust_penalty": 0, "role": "curiosity-leaf", "access_allowed": True,
                "rationale": ["query relevance 1.00", "authority 0.57", "graph importance 0.00", "token budget fit 0.55", "token count estimated as 5"],
            },
        }],
        "suppressed": None,
    },
    "pack": {
        "query_id": "q-api-pack", "query_type": "Factual",
        "slots": [{
            "index": 0, "slot_type": "support", "node_id": "policy", "role": "curiosity-leaf", "title": "Refund Policy", "text": "Refund policy text.", "token_count": 5, "score": 66.2, "position": "middle",
            "source": {"node_id": "policy", "origin": "", "source": "", "version": "v1", **TIMES}, "source_trail": HOPS, "must_cite": False,
            "rationale": "query relevance 1.00; authority 0.57; graph importance 0.00; token budget fit 1.00; token count estimated as 5; query type Factual modifier applied",
        }],
        "suppressed": None, "evidence_path": ["policy"], "source_trail": HOPS, "critique_summary": "Packed 1 slots with red hygiene and 0 suppressions.", "tokens_used": 5, "hygiene_signal": "red",
    },
}


@pytest.mark.parametrize("command", WANT)
def test_documents(spark, tmp_path, command):
    path, out = tmp_path / "request.json", io.StringIO()
    path.write_text(json.dumps(REQUEST))
    assert main([command, str(path), *(["--token-budget", "1200"] if command == "pack" else [])], spark, out) == 0
    assert out.getvalue() == json.dumps(WANT[command], indent=2) + "\n"


def test_refusals(spark, tmp_path, capsys):
    path = tmp_path / "request.json"
    path.write_text(json.dumps(REQUEST))
    assert main(["pack", str(path), "--no-allow-degraded"], spark) == 1 and "red-signal" in capsys.readouterr().err
    path.write_text(json.dumps(REQUEST | {"candidates": [{"node_id": "lost"}]}))
    assert main(["rank", str(path)], spark) == 1 and "lost" in capsys.readouterr().err
