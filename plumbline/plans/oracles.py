"""Reference SQL of the queries over the derived requests, for engines other than Spark."""

from __future__ import annotations

from plumbline.functions import expressions as x
from plumbline.functions import vocabulary as v
from plumbline.functions.expressions import OTHER as D
from plumbline.plans import docgraph

Y = docgraph.NOW_YEAR
TITLE = x.title_words("title", D)
ASCII = x.title_tokens("title", D)


def _similar(tokens: str) -> str:
    sets = f"(SELECT graph_id, id, list_distinct({tokens}) AS t FROM nodes)"
    each = f"(SELECT graph_id, id, t, unnest(t) AS w FROM {sets})"
    return f"""SELECT * FROM (SELECT p.graph_id, p.a, p.b, n / cast(p.la + p.lb - n AS double) AS similarity
        FROM (SELECT s.graph_id, s.id AS a, o.id AS b, len(s.t) AS la, len(o.t) AS lb, count(*) AS n FROM {each} s JOIN {each} o ON s.graph_id = o.graph_id AND s.w = o.w AND s.id < o.id GROUP BY ALL) p)
        WHERE similarity >= 0.88e0"""


def _required() -> str:
    rows = [(q, s, lim[0]) for q, row in v.SLOT_LIMITS.items() for s, lim in zip(v.SLOT_TYPES, row, strict=True) if lim and lim[0]]
    return "(VALUES " + ", ".join(f"('{q}', '{s}', {n})" for q, s, n in rows) + ") req(query_type, slot_type, least)"


def _ctes() -> dict[str, str]:
    """Steps by name; each reads only steps before it."""
    base = docgraph.texts(D)
    q = {"nodes": base["nodes"], "queries": base["queries"], "candidates": base["candidates"], "raw_edges": base["raw_edges"]}
    q["edges"] = f"""SELECT *, {x.edge_weight('type')} AS weight, {x.backlog_edge_weight('type')} AS backlog_weight FROM (
        SELECT graph_id, source_id, target_id, type AS raw, {x.edge_type('type', D)} AS type, confidence, {x.edge_note('type', 'note', D)} AS note, {x.edge_known('type', D)} AS known FROM raw_edges)"""
    q["ends"] = """SELECT graph_id, target_id AS id, source_id AS other, true AS incoming, type, confidence, note, backlog_weight FROM edges
        UNION ALL SELECT graph_id, source_id, target_id, false, type, confidence, note, backlog_weight FROM edges"""
    q["seen"] = """SELECT graph_id, id, count(*) AS degree, sum(CASE WHEN incoming THEN 1.0e0 ELSE 0.65e0 END * backlog_weight * confidence) AS raw,
        count(*) FILTER (incoming AND type = 'cites') AS cites_in, count(*) FILTER (incoming AND type = 'prerequisite') AS prereq_in, bool_or(incoming AND type = 'contradicts') AS contradicted,
        bool_or(type = 'overview') AS overview_edge, bool_or(type = 'duplicate') AS duplicate_edge, bool_or(type = 'prerequisite') AS prereq_edge,
        bool_or(type IN ('community-member-of', 'prerequisite', 'applies-to')) AS bridge_edge, bool_or(type IN ('evidence-against', 'contradicts')) AS counterpoint_edge,
        bool_or(type = 'related-to' AND contains(note, 'raw_type=')) AS unknown_edge FROM ends GROUP BY ALL"""
    q["features"] = f"""SELECT n.*, coalesce(degree, 0) AS degree, coalesce(cites_in, 0) AS cites_in, coalesce(prereq_in, 0) AS prereq_in, coalesce(contradicted, false) AS contradicted, coalesce(overview_edge, false) AS overview_edge,
        coalesce(duplicate_edge, false) AS duplicate_edge, coalesce(prereq_edge, false) AS prereq_edge, coalesce(bridge_edge, false) AS bridge_edge, coalesce(counterpoint_edge, false) AS counterpoint_edge, coalesce(unknown_edge, false) AS unknown_edge,
        CASE WHEN max(coalesce(raw, 0.0e0)) OVER g = 0 THEN 0.0e0 ELSE round({x.clamp('coalesce(raw, 0.0e0) / max(coalesce(raw, 0.0e0)) OVER g')} * 1000000000000.0e0) / 1000000000000.0e0 END AS centrality,
        CASE WHEN max(coalesce(cites_in, 0)) OVER g = 0 THEN 0.0e0 ELSE coalesce(cites_in, 0) / cast(max(coalesce(cites_in, 0)) OVER g AS double) END AS cites
        FROM nodes n LEFT JOIN seen s ON s.graph_id = n.graph_id AND s.id = n.id WINDOW g AS (PARTITION BY n.graph_id)"""
    q["authorities"] = f"""SELECT *, CASE WHEN max(raw_density) OVER (PARTITION BY graph_id) = 0 THEN 0.0e0 ELSE raw_density / max(raw_density) OVER (PARTITION BY graph_id) END AS density FROM (
        SELECT *, authority / greatest(1.0e0, log2(cast(tokens + 2 AS double))) AS raw_density FROM (
        SELECT *, {x.effective_tokens(D)} AS tokens, {x.authority_parts()} AS authority FROM (SELECT *, CASE WHEN len(approved_by) > 0 THEN 1.0e0 ELSE 0.0e0 END AS approved FROM features)))"""
    q["pairs"] = _similar(TITLE)
    q["links"] = """SELECT graph_id, a, b FROM pairs UNION SELECT graph_id, b, a FROM pairs
        UNION SELECT graph_id, source_id, target_id FROM edges WHERE type = 'duplicate' AND source_id <> target_id UNION SELECT graph_id, target_id, source_id FROM edges WHERE type = 'duplicate' AND source_id <> target_id"""
    q["reach"] = "SELECT graph_id, a AS id, a AS far FROM links UNION SELECT r.graph_id, r.id, l.b FROM reach r JOIN links l ON l.graph_id = r.graph_id AND l.a = r.far"
    q["clusters"] = "SELECT graph_id, id, min(far) AS cluster FROM reach GROUP BY ALL"
    q["spans"] = """SELECT n.graph_id, n.id, len(list_distinct(list_transform(n.topics, lambda t: lower(t)))) AS own_topics, coalesce(near, 0) AS near_topics FROM nodes n LEFT JOIN (
        SELECT e.graph_id, e.id, count(DISTINCT lower(t)) AS near FROM ends e JOIN (SELECT graph_id, id, unnest(topics) AS t FROM nodes) o ON o.graph_id = e.graph_id AND o.id = e.other GROUP BY ALL) s ON s.graph_id = n.graph_id AND s.id = n.id"""
    q["mets"] = """SELECT e.graph_id, e.target_id AS id, 1.0e0 - count(*) FILTER (s.status <> 'read') / cast(count(*) AS double) AS met
        FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.id = e.source_id WHERE e.type = 'prerequisite' GROUP BY ALL"""
    cue = x.any_of("lower(concat(type, ' ', title, ' ', notes))", ("foundation", "classic"))
    q["graphs"] = f"""SELECT *, {x.clamp(f"centrality * 0.55e0 + least(1.0e0, cast(2 * prereq_in + cites_in AS double) / 3.0e0) * 0.35e0 + CASE WHEN year > 0 AND {Y} - year >= 5 THEN 0.20e0 ELSE 0.0e0 END + CASE WHEN {cue} THEN 0.25e0 ELSE 0.0e0 END")} AS foundation_score,
        {x.clamp(f"cast(own_topics + near_topics AS double) / 6.0e0 * {x.clamp('cast(degree AS double) / 3.0e0')}")} AS bridge_score, {x.freshness(Y)} AS backlog_freshness, {x.stale_hype(Y)} AS stale_hype, {x.is_overview()} AS overview_cue,
        contains(lower(concat(title, ' ', notes)), 'counterpoint') AS counterpoint_cue, lower(concat(title, ' ', notes, ' ', array_to_string(topics, ' '))) AS goal_text
        FROM (SELECT a.* REPLACE (CASE WHEN a.notes = '' THEN a.text ELSE a.notes END AS notes), own_topics, near_topics, coalesce(met, 1.0e0) AS met, cluster
        FROM authorities a JOIN spans s ON s.graph_id = a.graph_id AND s.id = a.id LEFT JOIN mets m ON m.graph_id = a.graph_id AND m.id = a.id LEFT JOIN clusters c ON c.graph_id = a.graph_id AND c.id = a.id)"""
    q["fits"] = f"""SELECT *, {x.goal_fit('terms', 'goal_text', D)} AS fit FROM (SELECT q.query_id, q.query, {x.goal_terms('q.query', D)} AS terms, g.* FROM queries q JOIN graphs g ON g.graph_id = q.graph_id)"""
    from plumbline.operators.graph import role

    q["parts"] = f"""SELECT *, {x.clamp('(1.0e0 - abs(difficulty - 3) / 5.0e0) * 0.6e0 + met * 0.4e0')} AS raw_readiness, {x.energy_time_fit("''", '0')} AS energy_time_fit,
        CASE WHEN role = 'duplicate' THEN 0.75e0 WHEN cluster IS NOT NULL THEN 0.55e0 ELSE 0.0e0 END AS backlog_redundancy FROM (SELECT *, {role()} AS role FROM fits)"""
    q["legacy"] = f"""SELECT *, {x.rounded('100.0e0 * ' + x.clamp('fit * 0.30e0 + centrality * 0.20e0 + raw_readiness * 0.18e0 + backlog_freshness * 0.12e0 + energy_time_fit * 0.20e0 - backlog_redundancy * 0.22e0'), 1)} AS backlog_total,
        {x.rounded('raw_readiness', 2)} AS readiness2, {x.rounded('backlog_freshness', 2)} AS freshness2 FROM parts"""
    q["relevances"] = f"""SELECT l.*, c.relevance, {x.clamp('coalesce(c.relevance, 0.0e0)')} AS seed, (c.relevance IS NOT NULL OR l.query_id NOT IN (SELECT query_id FROM candidates)) AS ranked
        FROM legacy l LEFT JOIN (SELECT query_id, node_id, arg_max(query_relevance, pos) AS relevance FROM candidates GROUP BY ALL) c ON c.query_id = l.query_id AND c.node_id = l.id"""
    q["seeds"] = """SELECT query_id, graph_id, id, CASE WHEN sum(seed) OVER w = 0 THEN 1.0e0 / count(*) OVER w ELSE seed / sum(seed) OVER w END AS seed FROM relevances WINDOW w AS (PARTITION BY query_id)"""
    q["flows"] = """SELECT graph_id, source_id, target_id, w / sum(w) OVER (PARTITION BY graph_id, source_id) AS share FROM (
        SELECT graph_id, source_id, target_id, weight * CASE WHEN confidence <= 0 THEN 1.0e0 ELSE confidence END AS w FROM edges)"""
    q["steps"] = """SELECT query_id, source, target, sum(w) AS w, any_value(seed) AS seed FROM (
        SELECT s.query_id, f.source_id AS source, f.target_id AS target, f.share AS w, t.seed FROM seeds s JOIN flows f ON f.graph_id = s.graph_id AND f.source_id = s.id JOIN seeds t ON t.query_id = s.query_id AND t.id = f.target_id
        UNION ALL SELECT query_id, id, id, 0.0e0, seed FROM seeds
        UNION ALL SELECT s.query_id, s.id, t.id, t.seed, t.seed FROM seeds s JOIN seeds t ON t.query_id = s.query_id WHERE NOT EXISTS (SELECT 1 FROM flows f WHERE f.graph_id = s.graph_id AND f.source_id = s.id)) GROUP BY query_id, source, target"""
    q["walk"] = """SELECT query_id, id, seed AS score, 0 AS step FROM seeds UNION ALL
        SELECT p.query_id, c.target, 0.15e0 * any_value(c.seed) + 0.85e0 * sum(p.score * c.w), p.step + 1 FROM walk p JOIN steps c ON c.query_id = p.query_id AND c.source = p.id WHERE p.step < 100 GROUP BY p.query_id, c.target, p.step"""
    q["ppr"] = "SELECT w.query_id, w.id, CASE WHEN (SELECT count(*) FROM edges e JOIN queries q ON q.graph_id = e.graph_id WHERE q.query_id = w.query_id) < 2 THEN 0.0e0 ELSE w.score END AS ppr FROM walk w WHERE w.step = 100"
    q["rows"] = "SELECT r.*, p.ppr FROM relevances r JOIN ppr p ON p.query_id = r.query_id AND p.id = r.id"
    q["meta"] = """SELECT m.*, coalesce(has_decision_basis, false) AS has_decision_basis FROM (
        SELECT query_id, any_value(query) AS query, graph_id, list_sort(list(id) FILTER (chunk_type = 'entity')) AS entity_ids, bool_or(chunk_type = 'permission-record') AS has_permission,
        len(list_distinct(list_concat(list(community_id) FILTER (community_id <> ''), list(semantic_type) FILTER (semantic_type <> '')))) AS topic_span FROM rows GROUP BY query_id, graph_id) m
        LEFT JOIN (SELECT graph_id, bool_or(type = 'decision-basis') AS has_decision_basis FROM edges GROUP BY ALL) e ON e.graph_id = m.graph_id"""
    norm_id = f"array_to_string({x.tokens_of('e', D)}, ' ')"
    q["words"] = f"""SELECT *, coalesce(list_filter(coalesce(entity_ids, []), lambda e: contains(concat(' ', norm, ' '), concat(' ', {norm_id}, ' ')))[1], '') AS entity FROM (
        SELECT *, array_to_string(toks, ' ') AS norm FROM (SELECT *, {x.tokens_of('query', D)} AS toks FROM meta))"""
    q["routes"] = f"SELECT query_id, {x.routed(D, 1)} AS query_type, {x.routed(D, 2)} AS mode, cast({x.routed(D, 3)} AS int) AS budget_hint, {x.routed(D, 4)} AS reason FROM words"
    q["asked"] = """SELECT q.query_id, q.graph_id, q.query, q.clearance, q.allow_degraded, CASE WHEN q.query_type <> '' THEN q.query_type ELSE r.query_type END AS query_type,
        CASE WHEN token_budget > 0 THEN token_budget WHEN q.query_type <> '' THEN 4000 ELSE budget_hint END AS budget FROM queries q JOIN routes r ON r.query_id = q.query_id"""
    for name, caller in (
        ("rank", "SELECT query_id AS qid, clearance, caller_tenant, trusted_approvers, allow_unapproved, attribute_type AS query_type, token_budget AS budget FROM queries"),
        ("pack", "SELECT query_id AS qid, clearance, '' AS caller_tenant, cast([] AS varchar[]) AS trusted_approvers, true AS allow_unapproved, query_type, budget FROM asked"),
    ):
        q[f"{name}_gated"] = f"SELECT *, {x.denial(D)} AS denial FROM rows r JOIN ({caller}) c ON c.qid = r.query_id WHERE r.ranked"
        q[f"{name}_parts"] = f"""SELECT *, seed AS query_relevance, {x.clamp('0.55e0 * centrality + 0.45e0 * ppr')} AS graph_importance, {x.clamp('readiness2')} AS readiness, CASE WHEN superseded_by <> '' THEN 0.0e0 ELSE {x.clamp('freshness2')} END AS freshness,
            {x.clamp('0.6e0 * ' + x.length_fit('tokens', 'budget') + ' + 0.4e0 * density')} AS token_fit,
            1.0e0 - CASE WHEN trim(source) <> '' AND row_number() OVER (PARTITION BY query_id, source ORDER BY id) > 1 THEN 0.35e0 ELSE 0.0e0 END - CASE WHEN trim(community_id) <> '' AND row_number() OVER (PARTITION BY query_id, community_id ORDER BY id) > 1 THEN 0.25e0 ELSE 0.0e0 END AS diversity,
            CASE WHEN role = 'bridge' THEN 1.0e0 WHEN bridge_edge THEN 0.5e0 ELSE 0.0e0 END AS bridge_bonus, CASE WHEN role = 'counterpoint' THEN 1.0e0 WHEN counterpoint_edge THEN 0.5e0 ELSE 0.0e0 END AS counterpoint_bonus,
            CASE WHEN role = 'duplicate' OR cluster IS NOT NULL THEN 1.0e0 ELSE 0.0e0 END AS redundancy, CASE WHEN superseded_by <> '' THEN 1.0e0 ELSE 0.0e0 END AS staleness, {x.low_trust()} AS low_trust FROM {name}_gated WHERE denial IS NULL"""
        q[f"{name}_ranked"] = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) AS rank FROM (SELECT *, {x.total_score(x.positive(), x.negative(), x.modifier())} AS total FROM {name}_parts)"
    q["early"] = f"""SELECT *, {x.slot_limit(1)} AS most, CASE WHEN {x.slot_limit(1)} IS NULL THEN 1 WHEN superseded_by <> '' AND NOT (query_type = 'Temporal' AND {x.historical('query')}) THEN 2
        WHEN query_type = 'Agentic' AND slot_type IN ('permission', 'procedure', 'decision') AND len(approved_by) = 0 THEN 3 ELSE 0 END AS stop FROM (SELECT *, {x.slot_type()} AS slot_type FROM pack_ranked)"""
    q["doubles"] = """SELECT *, stop = 0 AND cluster IS NOT NULL AND row_number() OVER w > 1 AND NOT (query_type IN ('Comparative', 'Adversarial') AND first_value(chunk_type) OVER w <> chunk_type) AS twin FROM early
        WINDOW w AS (PARTITION BY query_id, cluster, stop = 0 ORDER BY rank)"""
    q["decided"] = """SELECT *, CASE WHEN stop = 1 THEN concat(slot_type, ' forbidden for ', query_type) WHEN stop = 2 THEN concat('superseded by ', superseded_by) WHEN stop = 3 THEN 'agentic controlling node lacks approval' WHEN over THEN concat(slot_type, ' slot full') ELSE '' END AS detail,
        CASE WHEN stop IN (1, 3) OR over THEN 'slot-policy' WHEN stop = 2 THEN 'stale' WHEN twin THEN 'duplicate' END AS reason FROM (
        SELECT *, stop = 0 AND NOT twin AND row_number() OVER (PARTITION BY query_id, slot_type, stop = 0 AND NOT twin ORDER BY rank) > most AS over FROM doubles)"""
    q["ordered"] = f"""SELECT *, {x.slot_priority()} AS priority, CASE WHEN position = 'middle' THEN CASE slot_type WHEN 'support' THEN 1 WHEN 'overview' THEN 2 WHEN 'bridge' THEN 3 END END AS turn
        FROM (SELECT *, {x.slot_position()} AS position FROM decided WHERE reason IS NULL)"""
    q["trimmed"] = """SELECT *, turn IS NOT NULL AND budget > 0 AND sum(tokens) OVER (PARTITION BY query_id) - coalesce(sum(tokens) OVER (PARTITION BY query_id, turn IS NULL ORDER BY turn, total, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > budget AS gone FROM ordered"""
    q["slots"] = "SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY CASE position WHEN 'front' THEN 0 WHEN 'middle' THEN 1 ELSE 2 END, priority, total DESC, id) - 1 AS int) AS idx FROM trimmed WHERE NOT gone"
    q["left_out"] = """SELECT query_id, id, 'access-control' AS reason, '' AS detail, 0.0e0 AS score FROM pack_gated WHERE denial IS NOT NULL UNION ALL SELECT query_id, id, reason, detail, total FROM decided WHERE reason IS NOT NULL
        UNION ALL SELECT query_id, id, 'budget', 'trimmed to token budget', total FROM trimmed WHERE gone"""
    q["signals"] = f"""SELECT a.query_id, a.query_type, CASE WHEN EXISTS (SELECT 1 FROM {_required()} WHERE req.query_type = (CASE WHEN a.query_type IN ({x.listed(v.SLOT_LIMITS)}) THEN a.query_type ELSE 'Factual' END)
        AND (SELECT count(*) FROM slots s WHERE s.query_id = a.query_id AND s.slot_type = req.slot_type) < req.least) THEN 'red' WHEN (SELECT min(total) FROM slots s WHERE s.query_id = a.query_id) < 55 THEN 'yellow' ELSE 'green' END AS signal FROM asked a"""
    q["flags"] = f"""SELECT r.query_id, r.graph_id, r.id, degree = 0 AS orphan, stale_hype OR role = 'stale-hype' OR superseded_by <> '' AS stale, prereq_edge AND NOT EXISTS (
        SELECT 1 FROM ends e JOIN rows o ON o.graph_id = e.graph_id AND o.id = e.other WHERE e.graph_id = r.graph_id AND e.id = r.id AND o.query_id = r.query_id AND o.role IN ('overview', 'bridge')) AS missing_bridge,
        cluster IS NOT NULL AS duplicate, trust < 0.35e0 AS low_trust, len(approved_by) = 0 AND chunk_type IN ({x.listed(v.CONTROLLING_CHUNKS)}) AS unapproved FROM rows r"""
    ratio = lambda c: f"cast(count(*) FILTER ({c}) AS double) / cast(count(*) AS double)"
    from plumbline.operators.hygiene import signal

    q["scores"] = f"""SELECT *, {signal('score')} AS signal FROM (SELECT query_id, {x.clamp(f"1.0e0 - 0.18e0 * ({ratio('orphan')}) - 0.18e0 * ({ratio('duplicate')}) - 0.20e0 * ({ratio('stale')}) - 0.20e0 * ({ratio('missing_bridge')}) - 0.14e0 * ({ratio('low_trust')}) - 0.10e0 * ({ratio('unapproved')})")} AS score FROM flags GROUP BY ALL)"""
    lacks = lambda s, t, kind: f"NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = a.graph_id AND e.source_id = {s} AND e.target_id = {t} AND e.type = '{kind}')"
    both = lambda kind: f"{lacks('a.id', 'b.id', kind)} AND {lacks('b.id', 'a.id', kind)}"
    overlap = "len(a.topics) > 0 AND len(b.topics) > 0 AND len(list_intersect(a.topics, b.topics)) / cast(least(len(list_distinct(a.topics)), len(list_distinct(b.topics))) AS double) >= 0.60e0"
    q["missing"] = f"""SELECT a.graph_id, b.id AS source_id, a.id AS target_id, 'supersedes' AS type, 1.00e0 AS confidence, 'superseded_by metadata' AS reason FROM nodes a JOIN nodes b ON b.graph_id = a.graph_id AND b.id = a.superseded_by WHERE a.id <> b.id AND {lacks('a.id', 'b.id', 'supersedes')}
        UNION ALL SELECT a.graph_id, a.id, b.id, 'same-question', 0.70e0, 'topic overlap in same community' FROM nodes a JOIN nodes b ON b.graph_id = a.graph_id AND a.community_id = b.community_id AND a.id < b.id WHERE a.community_id <> '' AND {overlap} AND {both('same-question')}
        UNION ALL SELECT a.graph_id, a.a, a.b, 'duplicate', 0.90e0, 'title similarity' FROM ({_similar(ASCII)}) a WHERE {both('duplicate').replace('a.id', 'a.a').replace('b.id', 'a.b')}
        UNION ALL SELECT a.graph_id, a.id, b.id, 'community-member-of', 0.80e0, 'shared community summary' FROM nodes a JOIN nodes b ON b.graph_id = a.graph_id AND a.community_id = b.community_id AND a.id <> b.id WHERE a.community_id <> '' AND b.chunk_type = 'community-summary' AND {lacks('a.id', 'b.id', 'community-member-of')}
        UNION ALL SELECT a.graph_id, a.id, b.id, 'exception-to', 0.55e0, 'policy exception title cue' FROM nodes a JOIN nodes b ON b.graph_id = a.graph_id AND a.id <> b.id WHERE contains(lower(a.title), 'exception') AND contains(lower(b.title), 'policy') AND {lacks('a.id', 'b.id', 'exception-to')}"""
    q["hops"] = """SELECT query_id, idx, id, 0 AS step, '' AS s, '' AS t, id AS node_id, 'retrieved' AS edge_type, coalesce(relevance, 0.0e0) AS confidence FROM slots
        UNION ALL SELECT query_id, idx, id, 1, '', '', id, 'slot-required', total / 100.0e0 FROM slots
        UNION ALL SELECT s.query_id, s.idx, s.id, 2, e.source_id, e.target_id, e.source_id, e.type, e.confidence FROM slots s JOIN edges e ON e.graph_id = s.graph_id AND e.target_id = s.id AND e.type = 'community-member-of' WHERE s.chunk_type = 'community-summary'
        UNION ALL SELECT s.query_id, s.idx, s.id, 3, e.source_id, e.target_id, e.target_id, e.type, e.confidence FROM slots s JOIN edges e ON e.graph_id = s.graph_id AND e.source_id = s.id AND e.type = 'decision-basis' WHERE s.chunk_type = 'decision'"""
    q["stored"] = """SELECT s.query_id, s.query_type, list_sort(list_distinct(list(lower(community_id)) FILTER (community_id <> ''))) AS topics,
        concat('sha256:', sha256(array_to_string(list_concat([s.query_type, array_to_string(list(id ORDER BY idx), '>')], list_sort(list_distinct(list(concat(id, '=', version))))), '|'))) AS plan_hash
        FROM slots s JOIN signals g ON g.query_id = s.query_id WHERE g.signal <> 'red' GROUP BY s.query_id, s.query_type"""
    q["star_edges"] = "SELECT cast(l_orderkey AS varchar) AS s, concat('p', cast(l_partkey AS varchar)) AS t, 1.10e0 AS w FROM lineitem UNION ALL SELECT cast(o_orderkey AS varchar), concat('c', cast(o_custkey AS varchar)), 0.60e0 FROM orders"
    return q


RECURSIVE = ("reach", "walk")


def sql(select: str, *needs: str) -> str:
    """select with the steps that it needs, and those that they need, in front."""
    steps = _ctes()
    wanted = set(needs)
    names = list(steps)
    for name in reversed(names):
        if name in wanted:
            body = f" {steps[name]} ".replace("\n", " ").replace("(", " ( ").replace(")", " ) ").replace(",", " , ")
            tokens = body.split()
            wanted |= {b for a, b in zip(tokens, tokens[1:], strict=False) if a in ("FROM", "JOIN") and b in steps and b != name}
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({steps[n]})" for n in names if n in wanted) + "\n" + select


def read_queue(budget: int = 180, limit: int = 5) -> str:
    """The greedy queue, one item a recursion."""
    first = sql("SELECT 1", "legacy").rsplit("\n", 1)[0]
    return f"""{first},
unread AS MATERIALIZED (SELECT query_id, id, length_minutes, cast(row_number() OVER (PARTITION BY query_id ORDER BY backlog_total DESC, id) AS int) AS place FROM legacy WHERE lower(status) <> 'read'),
fold AS (SELECT query_id, 0 AS at, 0 AS used, 0 AS n, false AS taken FROM (SELECT DISTINCT query_id FROM unread)
    UNION ALL SELECT f.query_id, u.place, CASE WHEN f.n < {limit} AND (f.used + u.length_minutes <= {budget} OR f.n = 0) THEN f.used + u.length_minutes ELSE f.used END,
        CASE WHEN f.n < {limit} AND (f.used + u.length_minutes <= {budget} OR f.n = 0) THEN f.n + 1 ELSE f.n END, f.n < {limit} AND (f.used + u.length_minutes <= {budget} OR f.n = 0)
    FROM fold f JOIN unread u ON u.query_id = f.query_id AND u.place = f.at + 1)
SELECT query_id, id, place, EXISTS (SELECT 1 FROM fold f WHERE f.query_id = u.query_id AND f.at = u.place AND f.taken) AS chosen FROM unread u"""
