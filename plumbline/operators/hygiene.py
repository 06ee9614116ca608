"""Hygiene of a graph: orphans, stale nodes, missing bridges and edges, score and signal."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.functions import vocabulary as v
from plumbline.functions.expressions import SPARK
from plumbline.operators.graph import DUPLICATE_SIMILARITY, cut, incident, similar_sets, title_sets

THRESHOLD, DEGRADED = 0.55, 0.70
TOPIC_OVERLAP = 0.60
#: Parts that the sources of a class are dealt over.
PARTS = 32


def flags(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, id, orphan, stale, missing_bridge, duplicate, low_trust and unapproved.

    rows: query_nodes(), with roles; edges: normalised_edges().
    """
    roles = rows.select("query_id", "graph_id", F.col("id").alias("other"), F.col("role").isin("overview", "bridge").alias("eases"))
    ends = incident(edges).select("graph_id", "id", "other").distinct()
    eased = roles.where("eases").join(ends, ["graph_id", "other"]).select("query_id", "id").distinct().withColumn("eased", F.lit(True))
    out = rows.join(eased, ["query_id", "id"], "left").fillna(False, ["eased"])
    return out.selectExpr(
        "query_id", "graph_id", "id", "degree = 0 AS orphan", "(stale_hype OR role = 'stale-hype' OR superseded_by <> '') AS stale",
        "(prereq_edge AND NOT eased) AS missing_bridge", "cluster IS NOT NULL AS duplicate", "trust < 0.35e0 AS low_trust",
        f"(size(approved_by) = 0 AND chunk_type IN ({x.listed(v.CONTROLLING_CHUNKS)})) AS unapproved",
    )


def graph_flags(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """flags() of each node of a graph, by graph_id and id: no flag depends on the query.

    rows: graph.standing(). Only foundations and leaves depend on goal fit, and no flag on them.
    """
    return flags(rows.withColumn("query_id", F.col("graph_id")), edges).drop("query_id")


def score() -> str:
    ratio = lambda c: f"cast(count_if({c}) AS double) / cast(count(*) AS double)"
    return x.clamp(f"1.0e0 - 0.18e0 * ({ratio('orphan')}) - 0.18e0 * ({ratio('duplicate')}) - 0.20e0 * ({ratio('stale')}) - 0.20e0 * ({ratio('missing_bridge')}) - 0.14e0 * ({ratio('low_trust')}) - 0.10e0 * ({ratio('unapproved')})")


def signal(column: str, threshold: float = THRESHOLD) -> str:
    return f"(CASE WHEN {column} < {x.number(threshold)} THEN 'red' WHEN {column} < {x.number(DEGRADED)} THEN 'yellow' ELSE 'green' END)"


def scores(flag_rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id, score and signal of each graph that a query sees."""
    rows = flag_rows.groupBy("query_id", "graph_id").agg(F.expr(score()).alias("score"))
    return rows.withColumn("signal", F.expr(signal("score", threshold if threshold > 0 else THRESHOLD)))


@dataclass(frozen=True)
class Rule:
    """Edges that should run from each source to each target whose class fits, unless they are there.

    sources, targets: graph_id, id and class; a node may be in several. fits: graph_id, class and
    other, where a class fits more than its own. there: graph_id, id and to of the edges that there
    are. mutual: sources and targets are the same, fits and there hold both ways round, and of two
    nodes the smaller id is the source.
    """

    kind: str
    confidence: str
    reason: str
    sources: DataFrame
    targets: DataFrame
    there: DataFrame
    fits: DataFrame | None = None
    mutual: bool = False

    def reversed(self) -> Rule:
        there = self.there.selectExpr("graph_id", "to AS id", "id AS to")
        return replace(self, sources=self.targets, targets=self.sources, there=there)


def _there(edges: DataFrame, kind: str, mutual: bool = False) -> DataFrame:
    have = edges.where(f"type = '{kind}'")
    rows = have.selectExpr("graph_id", "source_id AS id", "target_id AS to")
    return (rows.unionByName(have.selectExpr("graph_id", "target_id AS id", "source_id AS to")) if mutual else rows).distinct()


def _slim(nodes: DataFrame) -> DataFrame:
    return nodes.selectExpr("graph_id", "id", "title", "community_id", "chunk_type", "superseded_by", "array_sort(array_distinct(filter(transform(topics, t -> lower(trim(t))), t -> t <> ''))) AS topics")


def rules(nodes: DataFrame, edges: DataFrame) -> list[Rule]:
    """All rules of missing edges but that of superseded nodes, which names both of its ends.

    What a rule's plan reads several times is cut first, so that plans stay small.
    """
    slim = _slim(nodes)
    grouped = slim.where("community_id <> ''")

    about = grouped.where("size(topics) > 0").selectExpr("graph_id", "id", "struct(community_id, topics) AS class")
    classes = about.select("graph_id", "class").distinct()
    topic = classes.select("graph_id", "class", "class.community_id", F.explode("class.topics").alias("topic"))
    alike = topic.join(topic.withColumnRenamed("class", "other"), ["graph_id", "community_id", "topic"]).select("graph_id", "class", "other").distinct()
    alike = alike.where(f"size(array_intersect(class.topics, other.topics)) / cast(least(size(class.topics), size(other.topics)) AS double) >= {x.number(TOPIC_OVERLAP)}")

    sets = cut(title_sets(nodes, x.title_tokens("title", SPARK)))
    titles = sets.select("graph_id", "id", F.col("rep").alias("class"))
    near = similar_sets(sets, DUPLICATE_SIMILARITY)
    same = titles.selectExpr("graph_id", "class", "class AS other").distinct()
    same = same.unionByName(near.selectExpr("graph_id", "a AS class", "b AS other")).unionByName(near.selectExpr("graph_id", "b AS class", "a AS other")).distinct()

    member = grouped.selectExpr("graph_id", "id", "community_id AS class")
    summary = grouped.where("chunk_type = 'community-summary'").selectExpr("graph_id", "id", "community_id AS class")
    cued = lambda cue: slim.where(f"contains(lower(title), '{cue}')").selectExpr("graph_id", "id", "0 AS class")
    return [
        Rule("same-question", "0.70e0", "topic overlap in same community", about, about, cut(_there(edges, "same-question", True)), cut(alike), mutual=True),
        Rule("duplicate", "0.90e0", "title similarity", titles, titles, cut(_there(edges, "duplicate", True)), cut(same), mutual=True),
        Rule("community-member-of", "0.80e0", "shared community summary", member, summary, cut(_there(edges, "community-member-of"))),
        Rule("exception-to", "0.55e0", "policy exception title cue", cued("exception"), cued("policy"), cut(_there(edges, "exception-to"))),
    ]


def superseding(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The missing edges from superseding nodes; a superseded one names what supersedes it."""
    slim = _slim(nodes)
    old = slim.where("superseded_by <> '' AND superseded_by <> id").selectExpr("graph_id", "superseded_by AS source_id", "id AS target_id")
    rows = old.join(slim.select("graph_id", F.col("id").alias("source_id")), ["graph_id", "source_id"])
    # The look-up is for the edge from the old node to the new one.
    there = _there(edges, "supersedes").selectExpr("graph_id", "to AS source_id", "id AS target_id")
    rows = rows.join(there, ["graph_id", "source_id", "target_id"], "left_anti")
    return rows.selectExpr("graph_id", "source_id", "target_id", "'supersedes' AS type", "1.00e0 AS confidence", "'superseded_by metadata' AS reason")


def missing_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, source_id, target_id, type, confidence and reason of edges that should exist.

    Every edge is listed, so the result grows with the square of a class. Its pairs are made where
    they are returned and never dealt out: only nodes and edges are shuffled.
    """
    rows = superseding(nodes, edges)
    for rule in rules(nodes, edges):
        rows = rows.unionByName(_pairs(rule))
    return rows


def _pairs(rule: Rule) -> DataFrame:
    """The missing edges of a rule; a source brings the ids that it has edges to.

    Sources of a class are dealt over PARTS parts, to each of which all its targets go.
    """
    there = rule.there.groupBy("graph_id", "id").agg(F.collect_set("to").alias("there"))
    rows = rule.sources.join(there, ["graph_id", "id"], "left")
    # Of two classes, the larger's nodes aren't sources.
    rows = rows.withColumn("other", F.col("class")) if rule.fits is None else rows.join(rule.fits.where("class <= other"), ["graph_id", "class"])
    rows = rows.withColumn("part", F.expr(f"pmod(xxhash64(id), {PARTS})"))
    ends = rule.targets.selectExpr("graph_id", "id AS to", "class AS other", f"explode(sequence(0L, {PARTS - 1}L)) AS part")
    # Their number is given: by their bytes, Spark would join the parts again.
    keys, n = ["graph_id", "other", "part"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, *keys).join(ends.repartition(n, *keys), keys)
    apart = "(class <> other AND id <> to OR id < to)" if rule.mutual else "id <> to"
    found = found.where(f"{apart} AND NOT coalesce(array_contains(there, to), false)")
    both = ("least(id, to)", "greatest(id, to)") if rule.mutual else ("id", "to")
    return found.selectExpr("graph_id", f"{both[0]} AS source_id", f"{both[1]} AS target_id", f"'{rule.kind}' AS type", f"{rule.confidence} AS confidence", f"'{rule.reason}' AS reason")


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id and id of the nodes that missing edges begin or end at, each once.

    No pair of nodes is made, so this grows with nodes and edges, however many edges are missing.
    """
    rows = superseding(nodes, edges).selectExpr("graph_id", "explode(array(source_id, target_id)) AS id")
    for rule in rules(nodes, edges):
        for way in (rule,) if rule.mutual else (rule, rule.reversed()):
            rows = rows.unionByName(cut(_open_sources(way)))
    return rows.distinct()


def _open_sources(rule: Rule) -> DataFrame:
    """graph_id and id of sources that lack an edge to a target.

    One without edges lacks some if the smallest or the largest id that its class fits isn't its
    own. One with edges lacks some if a class has more ids than it has edges to, itself counted.
    """
    keys = ["graph_id", "id"]
    ids = cut(rule.targets.distinct())
    sizes = ids.groupBy("graph_id", F.col("class").alias("other")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    reach = cut(sizes.withColumn("class", F.col("other")) if rule.fits is None else rule.fits.join(sizes, ["graph_id", "other"]))
    span = reach.groupBy("graph_id", "class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    near = rule.sources.join(span, ["graph_id", "class"]).where("lo <> id OR hi <> id").select("graph_id", "id", "class")
    near = cut(near)
    busy = rule.there.select(keys).distinct()
    held = rule.there.unionByName(busy.selectExpr("graph_id", "id", "id AS to")).distinct()
    held = held.join(ids.selectExpr("graph_id", "id AS to", "class AS other"), ["graph_id", "to"]).groupBy("graph_id", "id", "other").agg(F.count("*").alias("held"))
    some = near.join(busy, keys, "left_semi").join(reach.select("graph_id", "class", "other", "n"), ["graph_id", "class"])
    some = some.join(held, ["graph_id", "id", "other"], "left").where("n > coalesce(held, 0)")
    return near.join(busy, keys, "left_anti").select(keys).unionByName(some.select(keys))


def retrieval_targets(queries: DataFrame, flag_rows: DataFrame, ends: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """query_id and id: what to retrieve for queries whose graph is red, where they don't allow it.

    flag_rows: graph_flags(); ends: missing_ends(). Rows, where reports() nests them in a cell.
    """
    red = scores(flag_rows.withColumn("query_id", F.col("graph_id")), threshold).where("signal = 'red'").select("graph_id")
    wanted = flag_rows.where("missing_bridge").select("graph_id", "id").unionByName(ends).distinct()
    return queries.where("NOT allow_degraded").select("query_id", "graph_id").join(red, "graph_id").join(wanted, "graph_id").select("query_id", "id")


def summaries(queries: DataFrame, flag_rows: DataFrame) -> DataFrame:
    """query_id, score, signal and counts by kind of every query; nothing is gathered in a cell."""
    kinds = ("orphan", "stale", "missing_bridge", "duplicate", "low_trust", "unapproved")
    counts = flag_rows.groupBy("query_id").agg(*(F.expr(f"count_if({k})").alias(f"n_{k}") for k in kinds))
    rows = queries.select("query_id").join(scores(flag_rows).drop("graph_id"), "query_id", "left").join(counts, "query_id", "left")
    return rows.withColumn("score", F.coalesce("score", F.lit(1.0))).withColumn("signal", F.coalesce("signal", F.lit("green"))).fillna(0, [f"n_{k}" for k in kinds])


def reports(queries: DataFrame, flag_rows: DataFrame, suggestions: DataFrame, clusters: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a query: clusters, id lists, suggestions, score, signal and retrieval targets.

    Reports aren't access-gated; they name nodes that the caller may not see. A row nests all
    that there is to say about its graph: for requests that bring their own; for many queries
    of a large shared graph there are summaries(), flags() and missing_edges().
    """
    ids = lambda c: F.expr(f"array_sort(filter(collect_list(CASE WHEN {c} THEN id END), i -> i IS NOT NULL))")
    lists = flag_rows.groupBy("query_id").agg(ids("orphan").alias("orphan_nodes"), ids("stale").alias("stale_nodes"), ids("missing_bridge").alias("missing_bridges"))
    cluster = clusters.groupBy("graph_id", "cluster").agg(F.array_sort(F.collect_list("id")).alias("ids")).groupBy("graph_id").agg(F.array_sort(F.collect_list("ids")).alias("duplicate_clusters"))
    edge = F.struct("source_id", "target_id", "type", "confidence", "reason")
    found = suggestions.groupBy("graph_id").agg(F.array_sort(F.collect_list(edge)).alias("missing_edges"))
    rows = queries.select("query_id", "graph_id", "allow_degraded").join(lists, "query_id", "left").join(scores(flag_rows, threshold).drop("graph_id"), "query_id", "left")
    rows = rows.join(cluster, "graph_id", "left").join(found, "graph_id", "left").withColumn("score", F.coalesce("score", F.lit(1.0))).withColumn("signal", F.coalesce("signal", F.lit("green")))
    ends = "flatten(transform(coalesce(missing_edges, array()), e -> array(e.source_id, e.target_id)))"
    return rows.withColumn("retrieval_targets", F.expr(f"CASE WHEN signal = 'red' AND NOT allow_degraded THEN array_sort(array_distinct(concat(coalesce(missing_bridges, array()), {ends}))) END")).drop("allow_degraded")
