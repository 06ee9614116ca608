"""Named queries against their reference SQL, and invariants of plans, on the smallest tables."""

import os

import duckdb
import pytest

from plumbline.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", plans.queries())
def test_query(spark, other, name):
    df = plans.queries()[name](spark, DIR)
    found = other.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()) == want


def test_every_query_has_reference_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


def test_plan_invariants(spark):
    a = plans.analysis(spark, DIR)
    denied = {(r["query_id"], r["id"]) for r in a.pack_gated.where("denial IS NOT NULL").select("query_id", "id").collect()}
    budgets = {r["query_id"]: (r["budget"], r["query_type"]) for r in a.recommendations.collect()}
    clusters, tokens, middle = {}, {}, {}
    for r in a.slots.select("query_id", "id", "cluster", "chunk_type", "tokens", "position", "slot_type", "total").collect():
        assert (r["query_id"], r["id"]) not in denied and 0 <= r["total"] <= 100
        if r["cluster"]:
            clusters.setdefault((r["query_id"], r["cluster"]), []).append(r["chunk_type"])
        tokens[r["query_id"]] = tokens.get(r["query_id"], 0) + r["tokens"]
        middle[r["query_id"]] = middle.get(r["query_id"], False) or (r["position"] == "middle" and r["slot_type"] in ("support", "overview", "bridge"))
    for (query, _), kinds in clusters.items():
        assert len(kinds) == 1 or budgets[query][1] in ("Comparative", "Adversarial")
    assert all(n <= budgets[q][0] or not middle[q] for q, n in tokens.items())
    everything = a.slots.select("query_id", "id").unionByName(a.left_out.select("query_id", "id"))
    assert everything.count() == everything.distinct().count() == a.rows.where("ranked").count()


def test_denied_rows_carry_no_text(spark):
    a = plans.analysis(spark, DIR)
    assert set(a.rank_suppressed.columns) == {"query_id", "id", "reason", "detail"}
    assert set(a.left_out.columns) == {"query_id", "id", "reason", "detail", "score"}


def test_plans_are_deterministic(spark):
    hashes = lambda: {r["query_id"]: r["plan_hash"] for r in plans.analysis(spark, DIR).plans.collect()}
    first = hashes()
    plans._analysis.cache_clear()
    assert hashes() == first


def test_full_context_packs_tenant_nodes(spark):
    a = plans.analysis(spark, DIR)
    seen = lambda rows: rows.where("denial IS NULL AND tenant_id <> ''").count()
    assert seen(a.pack_gated) == 0 and seen(a.pack_rows(full_context=True)) > 0


def test_edge_confidence_zero(spark):
    """No confidence weighs nothing in centrality, but one in PageRank."""
    from plumbline.operators import graph

    edges = spark.createDataFrame([("g", "a", "b", "cites", 0.0, ""), ("g", "b", "a", "supersedes", 0.0, "")], "graph_id string, source_id string, target_id string, type string, confidence double, note string")
    links = graph.normalised_edges(edges)
    nodes = spark.createDataFrame([("g", "a"), ("g", "b")], "graph_id string, id string")
    assert {r["centrality"] for r in graph.edge_features(nodes, links).collect()} == {0.0}
    seeds = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.0)], "query_id string, id string, seed double")
    ppr = graph.personalised_pagerank(seeds, links, spark.createDataFrame([("q", "g")], "query_id string, graph_id string"))
    assert sum(r["ppr"] for r in ppr.collect()) == pytest.approx(1, abs=1e-6)
    assert {r["type"]: (r["weight"], r["backlog_weight"]) for r in links.collect()} == {"cites": (1.1, 1.1), "supersedes": (1.4, 0.6)}
