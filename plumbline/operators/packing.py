"""Packing ranked rows into slot-limited, token-budgeted plans, by windows over the rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.functions import vocabulary as v
from plumbline.functions.expressions import SPARK


def decided(ranked: DataFrame) -> DataFrame:
    """Ranked rows with slot_type, reason and detail (null: packed).

    Each step looks only at rows that the steps before let through, in order of rank: a
    cluster is taken by the first node that reaches the check, even if its slot is full.
    """
    rows = ranked.withColumn("slot_type", F.expr(x.slot_type())).withColumn("most", F.expr(x.slot_limit(1)))
    historical = f"(query_type = 'Temporal' AND {x.historical('query')})"
    controlling = "slot_type IN ('permission', 'procedure', 'decision')"
    rows = rows.withColumn("early", F.expr(f"""CASE WHEN most IS NULL THEN 'forbidden' WHEN superseded_by <> '' AND NOT {historical} THEN 'stale'
        WHEN query_type = 'Agentic' AND {controlling} AND {SPARK.size('approved_by')} = 0 THEN 'unapproved' END"""))
    open_ = F.col("early").isNull()
    same = Window.partitionBy("query_id", "cluster", open_).orderBy("rank")
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumn("first_chunk", F.first("chunk_type").over(same))
    rows = rows.withColumn("duplicate", F.expr("early IS NULL AND cluster IS NOT NULL AND nth > 1 AND NOT (query_type IN ('Comparative', 'Adversarial') AND first_chunk <> chunk_type)"))
    left = F.expr("early IS NULL AND NOT duplicate")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "slot_type", left).orderBy("rank")))
    rows = rows.withColumn("full", F.expr("early IS NULL AND NOT duplicate AND place > most"))
    return rows.withColumn("reason", F.expr("CASE WHEN early = 'stale' THEN 'stale' WHEN early IS NOT NULL OR full THEN 'slot-policy' WHEN duplicate THEN 'duplicate' END")).withColumn(
        "detail",
        F.expr("""CASE early WHEN 'forbidden' THEN concat(slot_type, ' forbidden for ', query_type) WHEN 'stale' THEN concat('superseded by ', superseded_by)
            WHEN 'unapproved' THEN 'agentic controlling node lacks approval' ELSE CASE WHEN full THEN concat(slot_type, ' slot full') ELSE '' END END"""),
    ).drop("early", "nth", "first_chunk", "duplicate", "place", "full", "most")


def trimmed(decided_rows: DataFrame) -> DataFrame:
    """Packed rows with position, trimmed and index (from 0; null if trimmed).

    Over budget, middle support goes first, then overviews, then bridges, lowest score
    first: a row goes if the rows that go before it don't yet bring the plan within budget.
    """
    rows = decided_rows.where("reason IS NULL").withColumn("position", F.expr(x.slot_position()))
    rows = rows.withColumn("turn", F.expr("CASE WHEN position = 'middle' THEN CASE slot_type WHEN 'support' THEN 1 WHEN 'overview' THEN 2 WHEN 'bridge' THEN 3 END END"))
    query = Window.partitionBy("query_id")
    order = Window.partitionBy("query_id", F.col("turn").isNull()).orderBy("turn", "total", F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("all_tokens", F.sum("tokens").over(query)).withColumn("gone", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    rows = rows.withColumn("trimmed", F.expr("turn IS NOT NULL AND budget > 0 AND all_tokens - gone > budget"))
    rows = rows.withColumn("band", F.expr("CASE position WHEN 'front' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END")).withColumn("priority", F.expr(x.slot_priority()))
    shown = Window.partitionBy("query_id", "trimmed").orderBy("band", "priority", F.desc("total"), "id")
    return rows.withColumn("index", F.when(~F.col("trimmed"), F.row_number().over(shown) - 1)).drop("turn", "all_tokens", "gone", "band", "priority")


def slots(trimmed_rows: DataFrame) -> DataFrame:
    return trimmed_rows.where("NOT trimmed").withColumn("must_cite", F.expr("slot_type <> 'support'"))


def suppressions(denied: DataFrame, decided_rows: DataFrame, trimmed_rows: DataFrame) -> DataFrame:
    """query_id, id, reason, detail and score of everything that a plan left out."""
    gates = denied.selectExpr("query_id", "id", "'access-control' AS reason", "'' AS detail", "0.0e0 AS score")
    policy = decided_rows.where("reason IS NOT NULL").selectExpr("query_id", "id", "reason", "detail", "total AS score")
    budget = trimmed_rows.where("trimmed").selectExpr("query_id", "id", "'budget' AS reason", "'trimmed to token budget' AS detail", "total AS score")
    return gates.unionByName(policy).unionByName(budget)


def signals(queries: DataFrame, slot_rows: DataFrame) -> DataFrame:
    """query_id and signal of each plan; slot_rows: query_id, slot_type, total."""
    required = [(q, s, limits[0]) for q, row in v.SLOT_LIMITS.items() for s, limits in zip(v.SLOT_TYPES, row, strict=True) if limits and limits[0]]
    counts = slot_rows.groupBy("query_id").agg(*(F.expr(f"count_if(slot_type = '{s}')").alias(f"n_{s}") for s in v.SLOT_TYPES), F.min("total").alias("least"))
    rows = queries.select("query_id", "query_type").join(counts, "query_id", "left").fillna(0, [f"n_{s}" for s in v.SLOT_TYPES])
    known = f"query_type IN ({x.listed(v.SLOT_LIMITS)})"
    short = " OR ".join(f"({'query_type = ' + x.quote(q) if q != 'Factual' else f'(query_type = {x.quote(q)} OR NOT {known})'} AND n_{s} < {least})" for q, s, least in required)
    return rows.selectExpr("query_id", f"CASE WHEN {short} THEN 'red' WHEN least < 55 THEN 'yellow' ELSE 'green' END AS signal")


def plans(queries: DataFrame, slot_rows: DataFrame, left_out: DataFrame, hops: DataFrame | None = None) -> DataFrame:
    """One row a query: slots, suppressed, counts by reason, evidence path, trail, summary, tokens, signal."""
    columns = ["index", "slot_type", F.col("id").alias("node_id"), "role", "title", F.col("tokens").alias("token_count"), F.col("total").alias("score"), "position", "must_cite"]
    packed = slot_rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("slots"), F.sum("tokens").alias("tokens_used"))
    entry = F.struct(F.col("id").alias("node_id"), "reason", "detail", "score")
    out = left_out.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("suppressed"))
    by_reason = left_out.groupBy("query_id", "reason").count().groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("suppressed_by_reason"))
    own = F.col("request_id" if "request_id" in queries.columns else "query_id").cast("string").alias("own_id")
    rows = queries.select("query_id", "query_type", own).join(packed, "query_id", "left").join(out, "query_id", "left").join(by_reason, "query_id", "left").join(signals(queries, slot_rows), "query_id")
    if hops is not None:
        trail = hops.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "place", "node_id", "edge_type", "confidence"))).alias("hops"))
        rows = rows.join(trail.selectExpr("query_id", "transform(hops, h -> named_struct('node_id', h.node_id, 'edge_type', h.edge_type, 'confidence', h.confidence)) AS source_trail"), "query_id", "left")
    rows = rows.withColumn("evidence_path", F.expr("transform(coalesce(slots, array()), s -> s.node_id)")).fillna(0, ["tokens_used"])
    summary = "concat('Packed ', coalesce(size(slots), 0), ' slots with ', signal, ' hygiene and ', coalesce(size(suppressed), 0), ' suppressions.')"
    return rows.withColumn("critique_summary", F.expr(summary)).withColumn("plan_hash", F.expr(plan_hash())).drop("own_id")


def plan_hash() -> str:
    """Hash of a plan's structure: the request's own id (own_id), slots in order, suppressed in order, signal."""
    parts = "concat(array(own_id), evidence_path, array('--suppressed--'), transform(coalesce(suppressed, array()), s -> s.node_id), array(signal))"
    return f"sha2(array_join({parts}, char(0)), 256)"
