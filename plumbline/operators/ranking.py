"""Ranking: component scores, total and order; and the greedy reading queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.operators import graph


def last_candidates(candidates: DataFrame) -> DataFrame:
    """Of several candidates of a node the last one counts."""
    return candidates.groupBy("query_id", "node_id").agg(F.max_by("query_relevance", "pos").alias("relevance"))


def with_relevance(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """rows (query_id, id) with relevance, seed and ranked (whether the node is up for ranking)."""
    last = last_candidates(candidates).withColumnRenamed("node_id", "id")
    some = last.select("query_id").distinct().withColumn("has_candidates", F.lit(True))
    rows = rows.join(last, ["query_id", "id"], "left").join(some, "query_id", "left")
    return rows.selectExpr("*", f"{x.clamp('coalesce(relevance, 0.0e0)')} AS seed", "coalesce(relevance IS NOT NULL OR NOT has_candidates, true) AS ranked").drop("has_candidates")


def repeats(column: str, nth: str, loss: str) -> str:
    return f"CASE WHEN length(trim({column})) > 0 AND {nth} > 1 THEN {loss} ELSE 0.0e0 END"


def scored(rows: DataFrame) -> DataFrame:
    """Scores of gated rows that are ranked and allowed.

    They have a query_nodes() row's columns, seed, ppr, the caller's, query_type and budget.
    Diversity compares with the allowed nodes of smaller id.
    """
    rows = rows.where("ranked AND denial IS NULL")
    seen = {c: F.row_number().over(Window.partitionBy("query_id", c).orderBy("id")) for c in ("source", "community_id")}
    rows = rows.withColumn("nth_source", seen["source"]).withColumn("nth_community", seen["community_id"])
    rows = rows.selectExpr(
        "*",
        "seed AS query_relevance",
        f"{x.clamp('0.55e0 * centrality + 0.45e0 * ppr')} AS graph_importance",
        f"{x.clamp('readiness2')} AS readiness",
        f"CASE WHEN superseded_by <> '' THEN 0.0e0 ELSE {x.clamp('freshness2')} END AS freshness",
        f"{graph.token_fit()} AS token_fit",
        f"{x.clamp('1.0e0 - ' + repeats('source', 'nth_source', '0.35e0') + ' - ' + repeats('community_id', 'nth_community', '0.25e0'))} AS diversity",
        "CASE WHEN role = 'bridge' THEN 1.0e0 WHEN bridge_edge THEN 0.5e0 ELSE 0.0e0 END AS bridge_bonus",
        "CASE WHEN role = 'counterpoint' THEN 1.0e0 WHEN counterpoint_edge THEN 0.5e0 ELSE 0.0e0 END AS counterpoint_bonus",
        "CASE WHEN role = 'duplicate' OR cluster IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END AS redundancy",
        "CASE WHEN superseded_by <> '' THEN 1.0e0 ELSE 0.0e0 END AS staleness",
        f"{x.low_trust()} AS low_trust",
    )
    rows = rows.selectExpr("*", f"{x.positive()} AS positive", f"{x.negative()} AS negative", f"{x.modifier()} AS modifier")
    return rows.withColumn("total", F.expr(x.total_score())).drop("positive", "negative", "modifier")


def ranked(rows: DataFrame) -> DataFrame:
    """scored() rows with rank: total descending, then id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("total"), "id")))


def rationale() -> str:
    """The list of reasons of a scored row."""
    two = lambda label, column: f"concat('{label} ', {x.two_decimals(column)})"
    return f"""filter(array(
        {two('query relevance', 'query_relevance')}, {two('authority', 'authority')}, {two('graph importance', 'graph_importance')}, {two('token budget fit', 'token_fit')},
        CASE WHEN estimated THEN concat('token count estimated as ', tokens) END,
        CASE WHEN unknown_edge THEN 'unknown edge type weighted as related-to' END,
        CASE WHEN redundancy > 0 THEN {two('redundancy penalty', 'redundancy')} END,
        CASE WHEN staleness > 0 THEN {two('staleness penalty', 'staleness')} END,
        CASE WHEN low_trust > 0 THEN {two('low trust penalty', 'low_trust')} END,
        CASE WHEN query_type <> '' THEN concat('query type ', query_type, ' modifier applied') END
    ), r -> r IS NOT NULL)"""


def reading_queue(rows: DataFrame, budget: int = 180, limit: int = 5) -> DataFrame:
    """query_id, id, place (in total order), chosen, minutes and budget_exceeded.

    Unread items in order of total: each is taken while fewer than limit are and it fits
    into the rest of the budget; the first always is. The fold runs over one array a query.
    """
    budget, limit = budget if budget > 0 else 180, limit if limit > 0 else 5
    unread = rows.where("lower(status) <> 'read'").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("backlog_total"), "id")))
    lists = unread.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "length_minutes"))).alias("items"))
    fold = f"""aggregate(items, named_struct('used', 0L, 'n', 0, 'taken', cast(array() AS array<int>)), (s, i) ->
        CASE WHEN s.n < {limit} AND (s.used + i.length_minutes <= {budget} OR s.n = 0)
        THEN named_struct('used', s.used + i.length_minutes, 'n', s.n + 1, 'taken', array_append(s.taken, i.place)) ELSE s END)"""
    rows = lists.withColumn("fold", F.expr(fold)).select("query_id", F.explode("items").alias("i"), "fold")
    return rows.selectExpr("query_id", "i.id AS id", "i.place AS place", "array_contains(fold.taken, i.place) AS chosen", "i.length_minutes AS minutes", f"fold.used > {budget} AS budget_exceeded")


def explanation() -> str:
    """A sentence about a query_nodes() row."""
    c = {k: x.rounded(k, 2) for k in ("fit", "centrality", "backlog_redundancy", "energy_time_fit")}
    return f"""concat(array_join(filter(array(concat(title, ' is a ', role),
        CASE WHEN {c['fit']} >= 0.7e0 THEN 'strongly matches the goal' END,
        CASE WHEN {c['centrality']} >= 0.7e0 THEN 'unlocks several connected items' END,
        CASE WHEN readiness2 < 0.55e0 THEN 'may need prerequisites first' END,
        CASE WHEN {c['backlog_redundancy']} >= 0.5e0 THEN 'looks redundant with another backlog item' END,
        CASE WHEN {c['energy_time_fit']} >= 0.8e0 THEN 'fits the current time/energy budget' END), p -> p IS NOT NULL), '; '), '.')"""
