"""Graph features: degrees, centrality, citations, duplicates, roles and PageRank.

Tables are keyed by graph_id; a request that brings its own graph has graph_id = query_id.
Features use the whole graph: access gates come later and never change them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.functions import vocabulary as v
from plumbline.functions.expressions import SPARK

DUPLICATE_SIMILARITY = 0.88
#: Links that one task follows.
TASK_LINKS = 500_000
#: Terms that a text is looked through for at once.
TERMS = 256
RESTART, ITERATIONS, TOLERANCE = 0.15, 100, 1e-8


def normalised_edges(edges: DataFrame) -> DataFrame:
    """graph_id, source_id, target_id, type (canonical), confidence, note, both weights, known."""
    rows = edges.selectExpr("graph_id", "source_id", "target_id", "coalesce(type, '') AS raw", "coalesce(confidence, 0.0e0) AS confidence", "coalesce(note, '') AS note")
    names = F.create_map(*(F.lit(t) for pair in {**{k: k for k in v.EDGE_WEIGHTS}, **v.EDGE_ALIASES}.items() for t in pair))
    rows = rows.withColumn("token", F.expr(x.edge_token("raw", SPARK))).withColumn("type", F.try_element_at(names, F.col("token")))
    rows = rows.withColumn("known", F.col("type").isNotNull()).withColumn("type", F.coalesce("type", F.lit("related-to")))
    rows = rows.withColumn("note", F.expr("CASE WHEN raw <> '' AND raw <> type AND note = '' THEN concat('raw_type=', raw) ELSE note END")).drop("token")
    return rows.selectExpr("*", f"{x.edge_weight('type')} AS weight", f"{x.backlog_edge_weight('type')} AS backlog_weight")


def incident(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: graph_id, id, other, incoming and the edge's columns."""
    into = edges.selectExpr("graph_id", "target_id AS id", "source_id AS other", "true AS incoming", "type", "confidence", "note", "weight", "backlog_weight")
    out = edges.selectExpr("graph_id", "source_id AS id", "target_id AS other", "false AS incoming", "type", "confidence", "note", "weight", "backlog_weight")
    return into.unionByName(out)


def edge_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One aggregation over all edge ends; nodes without edges get zeros."""
    ends = incident(edges)
    seen = ends.groupBy("graph_id", "id").agg(
        F.count("*").alias("degree"),
        F.expr("sum(CASE WHEN incoming THEN 1.0e0 ELSE 0.65e0 END * backlog_weight * confidence)").alias("raw_centrality"),
        F.expr("count_if(incoming AND type = 'cites')").alias("cites_in"),
        F.expr("count_if(incoming AND type = 'prerequisite')").alias("prereq_in"),
        F.expr("bool_or(incoming AND type = 'contradicts')").alias("contradicted"),
        F.expr("bool_or(type = 'overview')").alias("overview_edge"),
        F.expr("bool_or(type = 'duplicate')").alias("duplicate_edge"),
        F.expr("bool_or(type = 'prerequisite')").alias("prereq_edge"),
        F.expr("bool_or(type IN ('community-member-of', 'prerequisite', 'applies-to'))").alias("bridge_edge"),
        F.expr("bool_or(type IN ('evidence-against', 'contradicts'))").alias("counterpoint_edge"),
        F.expr("bool_or(type = 'related-to' AND contains(note, 'raw_type='))").alias("unknown_edge"),
    )
    rows = nodes.select("graph_id", "id").join(seen, ["graph_id", "id"], "left")
    flags = ("contradicted", "overview_edge", "duplicate_edge", "prereq_edge", "bridge_edge", "counterpoint_edge", "unknown_edge")
    rows = rows.fillna(0, ["degree", "raw_centrality", "cites_in", "prereq_in"]).fillna(False, list(flags))
    # One row a graph, from partial maxima: no task holds a graph.
    tops = rows.groupBy("graph_id").agg(F.max("raw_centrality").alias("top"), F.max("cites_in").alias("top_cites"))
    rows = rows.join(tops, "graph_id")
    return rows.selectExpr(
        "graph_id", "id", "degree", "prereq_in", "cites_in", *flags,
        f"CASE WHEN top = 0 THEN 0.0e0 ELSE round({x.clamp('raw_centrality / top')} * 1000000000000.0e0) / 1000000000000.0e0 END AS centrality",
        "CASE WHEN top_cites = 0 THEN 0.0e0 ELSE cites_in / cast(top_cites AS double) END AS cites",
    )


def title_sets(nodes: DataFrame, tokens: str) -> DataFrame:
    """graph_id, id, tokens (distinct, sorted) and rep, the smallest id with the same tokens."""
    sets = nodes.selectExpr("graph_id", "id", f"array_sort(array_distinct({tokens})) AS tokens").where("size(tokens) > 0")
    reps = sets.groupBy("graph_id", "tokens").agg(F.min("id").alias("rep"))
    return sets.join(reps, ["graph_id", "tokens"])


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of representatives whose token sets have the Jaccard similarity.

    Equal sets are one. Only sets meet that share one of the tokens that a similar pair must
    share: of each, ordered from the rarest, size - ceil(least * size) + 1 tokens.
    """
    one = sets.where("id = rep").select("graph_id", "id", "tokens", F.size("tokens").alias("n"))
    each = one.select("graph_id", "id", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("graph_id", "token").agg(F.count("*").alias("often"))
    order = Window.partitionBy("graph_id", "id").orderBy("often", "token")
    prefix = each.join(often, ["graph_id", "token"]).withColumn("place", F.row_number().over(order)).where(f"place <= n - ceil({least} * n) + 1")
    prefix = prefix.select("graph_id", "token", "id", "n")
    other = prefix.select("graph_id", "token", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = prefix.withColumnRenamed("id", "a").join(other, ["graph_id", "token"]).where(f"a < b AND least(n, nb) >= {least} * greatest(n, nb)").select("graph_id", "a", "b").distinct()
    pairs = pairs.join(one.selectExpr("graph_id", "id AS a", "tokens AS ta"), ["graph_id", "a"]).join(one.selectExpr("graph_id", "id AS b", "tokens AS tb"), ["graph_id", "b"])
    pairs = pairs.withColumn("similarity", F.expr("size(array_intersect(ta, tb)) / cast(size(array_union(ta, tb)) AS double)"))
    return pairs.where(f"similarity >= {least}").select("graph_id", "a", "b", "similarity")


def similar_titles(nodes: DataFrame, tokens: str, least: float = DUPLICATE_SIMILARITY) -> DataFrame:
    """Pairs a < b of one graph whose title token sets have the Jaccard similarity.

    tokens: SQL over title. The result lists every pair, so it grows with the square of a
    group of equal titles; duplicate_clusters() doesn't need it.
    """
    sets = title_sets(nodes, tokens)
    between = similar_sets(sets, least)
    own = sets.select("graph_id", F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    members = sets.select("graph_id", "rep", "id")
    pairs = own.unionByName(between).join(members.selectExpr("graph_id", "rep AS a", "id AS x"), ["graph_id", "a"]).join(members.selectExpr("graph_id", "rep AS b", "id AS y"), ["graph_id", "b"])
    # Each pair of two sets once, and of one set's members in one order.
    pairs = pairs.where("a <> b OR x < y")
    return pairs.selectExpr("graph_id", "least(x, y) AS a", "greatest(x, y) AS b", "similarity")


def duplicate_clusters(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """graph_id, id and cluster (its smallest id) of every node in a cluster of two or more.

    Links are duplicate edges, similar titles, and equal titles with their first. Few of them
    are followed in one task; more spread labels by minima, with a jump to the label's label
    in each round, until a round changes none. Both give the same.
    """
    links = edges.where("type = 'duplicate' AND source_id <> target_id").selectExpr("graph_id", "source_id AS a", "target_id AS b")
    sets = cut(title_sets(nodes, x.title_words("title", SPARK)))
    links = links.unionByName(similar_sets(sets, DUPLICATE_SIMILARITY).select("graph_id", "a", "b")).unionByName(sets.where("id <> rep").selectExpr("graph_id", "rep AS a", "id AS b"))
    links = cut(links.distinct())
    if links.limit(TASK_LINKS + 1).count() <= TASK_LINKS:
        return cut(links.coalesce(1).mapInPandas(_clustered, f"graph_id {links.schema['graph_id'].dataType.simpleString()}, id string, cluster string"))
    both = links.unionByName(links.selectExpr("graph_id", "b AS a", "a AS b")).distinct()
    both = cut(both)
    labels = cut(both.groupBy("graph_id", F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("cluster")))
    for _ in range(most_rounds):
        spread = both.join(labels.withColumnRenamed("id", "b"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("id")).agg(F.min("cluster").alias("seen"))
        near = labels.join(spread, ["graph_id", "id"]).selectExpr("graph_id", "id", "cluster AS old", "least(cluster, seen) AS cluster")
        jump = near.selectExpr("graph_id", "id AS cluster", "cluster AS further")
        new = cut(near.join(jump, ["graph_id", "cluster"], "left").selectExpr("graph_id", "id", "old", "coalesce(least(cluster, further), cluster) AS cluster"))
        labels = new.select("graph_id", "id", "cluster")
        if new.where("old <> cluster").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def _clustered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels of one task's links: the smallest id that each end reaches."""
    held = [p for p in parts if len(p)]
    if not held:
        return
    links = pd.concat(held, ignore_index=True)
    ends = pd.concat([links[["graph_id", c]].rename(columns={c: "id"}) for c in ("a", "b")], ignore_index=True)
    nodes = ends.drop_duplicates().sort_values(["graph_id", "id"], ignore_index=True)
    place = ends.merge(nodes.reset_index(), on=["graph_id", "id"], how="left")["index"].to_numpy(int)
    a, b = place[: len(links)], place[len(links) :]
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before, low = label.copy(), np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, end, low)
            np.minimum.at(label, before[end], low)
        label = label[label]
    yield nodes.assign(cluster=nodes["id"].to_numpy()[label])


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared checkpoint folder, so that a loop's plan stays short."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            root = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint()


def authority(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """graph_id, id, tokens, authority, and density relative to the graph's largest."""
    rows = nodes.join(features.select("graph_id", "id", "cites"), ["graph_id", "id"])
    rows = rows.withColumn("approved", F.expr("CASE WHEN size(approved_by) > 0 THEN 1.0e0 ELSE 0.0e0 END")).withColumn("authority", F.expr(x.authority_parts()))
    rows = rows.withColumn("tokens", F.expr(x.effective_tokens(SPARK)))
    rows = rows.withColumn("raw_density", F.expr("authority / greatest(1.0e0, log2(cast(tokens + 2 AS double)))"))
    rows = rows.join(rows.groupBy("graph_id").agg(F.max("raw_density").alias("top")), "graph_id")
    return rows.selectExpr("graph_id", "id", "tokens", "authority", "CASE WHEN top = 0 THEN 0.0e0 ELSE raw_density / top END AS token_density")


def token_fit(tokens: str = "tokens", budget: str = "budget", density: str = "token_density") -> str:
    return x.clamp(f"0.6e0 * {x.length_fit(tokens, budget)} + 0.4e0 * {density}")


def topic_spans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, id, own_topics and near_topics: distinct topics of a node and of its neighbours."""
    own = nodes.selectExpr("graph_id", "id", "size(array_distinct(transform(topics, t -> lower(t)))) AS own_topics")
    topics = nodes.select("graph_id", F.col("id").alias("other"), F.explode("topics").alias("topic"))
    near = incident(edges).select("graph_id", "id", "other").distinct().join(topics, ["graph_id", "other"]).groupBy("graph_id", "id").agg(F.expr("count(DISTINCT lower(topic))").alias("near_topics"))
    return own.join(near, ["graph_id", "id"], "left").fillna(0, ["near_topics"])


def prerequisites(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, id, and the share of its prerequisites that have been read (1 without any)."""
    source = nodes.selectExpr("graph_id", "id AS source_id", "lower(status) = 'read' AS done")
    needed = edges.where("type = 'prerequisite'").join(source, ["graph_id", "source_id"])
    met = needed.groupBy("graph_id", F.col("target_id").alias("id")).agg(F.expr("1.0e0 - count_if(NOT done) / cast(count(*) AS double)").alias("met"))
    return nodes.select("graph_id", "id").join(met, ["graph_id", "id"], "left").fillna(1.0, ["met"])


#: Over a node's own columns.
NOTES = "CASE WHEN notes = '' THEN text ELSE notes END"
FOUNDATION_CUE = x.any_of("lower(concat(type, ' ', title, ' ', notes))", ("foundation", "classic"))
COUNTERPOINT_CUE = "contains(lower(concat(title, ' ', notes)), 'counterpoint')"


def foundation_score(now_year: int, cue: str) -> str:
    return x.clamp(f"centrality * 0.55e0 + least(1.0e0, cast(2 * prereq_in + cites_in AS double) / 3.0e0) * 0.35e0 + CASE WHEN year > 0 AND {now_year} - year >= 5 THEN 0.20e0 ELSE 0.0e0 END + CASE WHEN {cue} THEN 0.25e0 ELSE 0.0e0 END")


def bridge_score() -> str:
    return x.clamp(f"cast(own_topics + near_topics AS double) / 6.0e0 * {x.clamp('cast(degree AS double) / 3.0e0')}")


def cues(nodes: DataFrame, now_year: int) -> DataFrame:
    """What hygiene reads of a node, without its text: that is looked through before any join."""
    return nodes.withColumn("notes", F.expr(NOTES)).selectExpr(
        "graph_id", "id", "title", "topics", "community_id", "chunk_type", "superseded_by", "approved_by", "trust", "year",
        f"{FOUNDATION_CUE} AS foundation_cue", f"{x.stale_hype(now_year)} AS stale_hype", f"{x.is_overview()} AS overview_cue", f"{COUNTERPOINT_CUE} AS counterpoint_cue",
    )


def standing(nodes: DataFrame, edges: DataFrame, now_year: int) -> DataFrame:
    """Degree, edge flags, cluster and role of each node, at goal fit 0.

    nodes: from cues(). The fit decides only between roles after 'bridge'.
    """
    keys = ["graph_id", "id"]
    features = edge_features(nodes.select(keys).distinct(), edges)
    rows = nodes.join(features, keys).join(topic_spans(nodes, edges), keys).join(duplicate_clusters(nodes, edges), keys, "left")
    rows = rows.selectExpr("*", "0.0e0 AS fit", f"{foundation_score(now_year, 'foundation_cue')} AS foundation_score", f"{bridge_score()} AS bridge_score")
    return rows.withColumn("role", F.expr(role()))


def graph_table(nodes: DataFrame, edges: DataFrame, now_year: int) -> DataFrame:
    """All features of a node that don't depend on the query, without its text.

    edges: from normalised_edges(). It adds what scoring needs of the node itself and the
    lower-case text that goal terms are looked for in.
    """
    features = edge_features(nodes, edges)
    clusters = duplicate_clusters(nodes, edges)
    keys = ["graph_id", "id"]
    rows = nodes.join(features, keys).join(authority(nodes, features), keys).join(topic_spans(nodes, edges), keys).join(prerequisites(nodes, edges), keys).join(clusters, keys, "left")
    rows = rows.withColumn("notes", F.expr(NOTES))
    return rows.selectExpr(
        "*",
        "lower(concat(title, ' ', notes, ' ', array_join(topics, ' '))) AS goal_text",
        f"{foundation_score(now_year, FOUNDATION_CUE)} AS foundation_score", f"{bridge_score()} AS bridge_score",
        f"{x.freshness(now_year)} AS backlog_freshness", f"{x.stale_hype(now_year)} AS stale_hype", f"{x.is_overview()} AS overview_cue",
        f"{COUNTERPOINT_CUE} AS counterpoint_cue",
        "token_count = 0 AND text <> '' AS estimated",
    ).drop("text", "notes")


def role() -> str:
    """The role by the first rule that holds; reads a graph table's columns and fit (goal fit)."""
    return """(CASE WHEN cluster IS NOT NULL OR duplicate_edge THEN 'duplicate'
        WHEN contradicted OR counterpoint_cue THEN 'counterpoint'
        WHEN overview_cue OR overview_edge THEN 'overview'
        WHEN stale_hype THEN 'stale-hype'
        WHEN foundation_score >= 0.60e0 THEN 'foundation'
        WHEN bridge_score >= 0.55e0 THEN 'bridge'
        WHEN degree <= 1 AND fit < 0.45e0 THEN 'curiosity-leaf'
        WHEN centrality >= 0.70e0 THEN 'foundation'
        ELSE 'curiosity-leaf' END)"""


def term_hits(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """graph_id, id and hits: which of the terms that its graph's queries ask for a node's text holds.

    wanted: graph_id and terms. A text is read once for each TERMS distinct terms, however
    many queries ask for them, and doesn't leave its row.
    """
    terms = wanted.selectExpr("graph_id", "explode(terms) AS term").distinct()
    sizes = terms.groupBy("graph_id").agg(F.count("*").alias("n"))
    packs = terms.join(sizes, "graph_id").groupBy("graph_id", F.pmod(F.xxhash64("term"), F.ceil(F.col("n") / TERMS)).alias("pack")).agg(F.collect_list("term").alias("asked"))
    found = table.select("graph_id", "id", "goal_text").join(packs.drop("pack"), "graph_id").selectExpr("graph_id", "id", "filter(asked, t -> contains(goal_text, t)) AS hits")
    return found.where("size(hits) > 0").groupBy("graph_id", "id").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def query_nodes(queries: DataFrame, table: DataFrame) -> DataFrame:
    """Each query with each node of its graph: goal fit, role and the backlog score's parts.

    queries: query_id, graph_id, query, and optionally goal_topics, familiarity, goal_energy
    and goal_minutes.
    """
    wanted = queries
    for name, default in (("goal_topics", "cast(array() AS array<string>)"), ("familiarity", "0"), ("goal_energy", "''"), ("goal_minutes", "0")):
        if name not in wanted.columns:
            wanted = wanted.withColumn(name, F.expr(default))
    topics = x.SPARK.keep(x.SPARK.each("goal_topics", "t", x.SPARK.trimmed("lower(t)", " ,.;:!?()[]{}\"'")), "t", "octet_length(t) > 3")
    wanted = wanted.withColumn("terms", F.expr(f"concat({topics}, {x.goal_terms('query', SPARK)})"))
    held = table.drop("goal_text").join(term_hits(wanted, table), ["graph_id", "id"], "left")
    found = "size(filter(terms, t -> array_contains(coalesce(hits, cast(array() AS array<string>)), t)))"
    rows = wanted.join(held, "graph_id").withColumn("fit", F.expr(x.goal_fit_of(found))).drop("terms", "hits")
    rows = rows.withColumn("role", F.expr(role()))
    familiarity = "(CASE WHEN familiarity = 0 THEN 3 ELSE familiarity END)"
    return rows.selectExpr(
        "*",
        f"{x.clamp(f'(1.0e0 - abs(difficulty - {familiarity}) / 5.0e0) * 0.6e0 + met * 0.4e0')} AS raw_readiness",
        f"{x.energy_time_fit('goal_energy', 'goal_minutes')} AS energy_time_fit",
        "CASE WHEN role = 'duplicate' THEN 0.75e0 WHEN cluster IS NOT NULL THEN 0.55e0 ELSE 0.0e0 END AS backlog_redundancy",
    ).selectExpr(
        "*",
        f"""{x.rounded('100.0e0 * ' + x.clamp('fit * 0.30e0 + centrality * 0.20e0 + raw_readiness * 0.18e0 + backlog_freshness * 0.12e0 + energy_time_fit * 0.20e0 - backlog_redundancy * 0.22e0'), 1)} AS backlog_total""",
        f"{x.rounded('raw_readiness', 2)} AS readiness2", f"{x.rounded('backlog_freshness', 2)} AS freshness2",
    )


def _iterate(nodes: pd.DataFrame, edges: pd.DataFrame) -> np.ndarray:
    """Scores of nodes (sorted ids with seeds) by power iteration."""
    n = len(nodes)
    if len(edges) < 2:
        return np.zeros(n)
    seeds = nodes["seed"].to_numpy(float)
    seeds = seeds / seeds.sum() if seeds.sum() else np.full(n, 1 / n)
    place = pd.Series(np.arange(n), nodes["id"].to_numpy())
    source, target = place[edges["source_id"]].to_numpy(), place[edges["target_id"]].to_numpy()
    weight = edges["w"].to_numpy(float)
    out = np.bincount(source, weight, n)
    share, dangling, now = weight / out[source], out == 0, seeds.copy()
    for _ in range(ITERATIONS):
        new = RESTART * seeds + np.bincount(target, (1 - RESTART) * now[source] * share, n) + (1 - RESTART) * now[dangling].sum() * seeds
        if np.abs(new - now).sum() < TOLERANCE:
            return new
        now = new
    return now


def personalised_pagerank(query_nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id and ppr. query_nodes: query_id, id, seed (clamped relevance, 0 if none).

    One query's graph is one group: its iterations need no shuffle between them.
    """
    weighted = edges.selectExpr("graph_id", "source_id", "target_id", "weight * CASE WHEN confidence <= 0 THEN 1.0e0 ELSE confidence END AS w")
    weighted = queries.select("query_id", "graph_id").join(weighted, "graph_id").select(F.col("query_id").alias("q"), "source_id", "target_id", "w")
    seeded = query_nodes.select("query_id", "id", "seed")

    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id", ignore_index=True)
        links = links.sort_values(["source_id", "target_id", "w"], ignore_index=True)
        return pd.DataFrame({"query_id": nodes["query_id"], "id": nodes["id"], "ppr": _iterate(nodes, links)})

    kind = query_nodes.schema["query_id"].dataType.simpleString()
    return seeded.groupBy("query_id").cogroup(weighted.groupBy("q")).applyInPandas(run, f"query_id {kind}, id string, ppr double")
