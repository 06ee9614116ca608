"""SQL expressions of the scoring rules, as text over named columns.

Where Spark and other engines agree on the syntax, one text serves both; what differs lies
in Dialect. Missing values are '' and 0, as prepared at the sources.
"""

from __future__ import annotations

from dataclasses import dataclass

from plumbline.functions import vocabulary as v


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quote(x) for x in values)


def number(x: float) -> str:
    """A double literal."""
    return f"{x!r}e0" if isinstance(x, float) else str(x)


def choose(column: str, table: dict, other) -> str:
    """CASE over the values of a table; other: what the rest get, as SQL."""
    shown = lambda x: quote(x) if isinstance(x, str) else number(x)
    return f"(CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {shown(x)}" for k, x in table.items()) + f" ELSE {other} END)"


def clamp(x: str) -> str:
    return f"greatest(0.0e0, least(1.0e0, {x}))"


def rounded(x: str, digits: int) -> str:
    """Half away from zero on the scaled double."""
    scale = f"1{'0' * digits}.0e0"
    return f"(round(({x}) * {scale}) / {scale})"


def two_decimals(x: str) -> str:
    """Text of a column (at least 0) with two decimals, rounded as its binary value is, ties to even.

    200 * x is held exactly, as a rounded product and its error; k is its whole part.
    """
    high = f"({x} * 134217729.0e0 - ({x} * 134217729.0e0 - {x}))"
    error = f"(({high} * 200.0e0 - {x} * 200.0e0) + ({x} - {high}) * 200.0e0)"
    whole = f"({x} * 200.0e0 = floor({x} * 200.0e0))"
    k = f"(cast(floor({x} * 200.0e0) AS bigint) - CASE WHEN {whole} AND {error} < 0 THEN 1 ELSE 0 END)"
    n = f"(CASE WHEN {k} % 2 = 0 THEN {k} DIV 2 WHEN {whole} AND {error} = 0 THEN ({k} + 1) DIV 4 * 2 ELSE ({k} + 1) DIV 2 END)"
    return f"concat({n} DIV 100, '.', lpad(cast({n} % 100 AS string), 2, '0'))"


@dataclass(frozen=True)
class Dialect:
    """What one engine writes in its own way."""

    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def pattern(self, text: str) -> str:
        return "r" + quote(text) if self.spark else quote(text)

    def replaced(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.pattern(pattern)}, {quote(by)}" + (")" if self.spark else ", 'g')")

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.pattern(pattern)})" if self.spark else f"regexp_split_to_array({x}, {quote(pattern)})"

    def keep(self, array: str, var: str, condition: str) -> str:
        return f"filter({array}, {var} -> {condition})" if self.spark else f"list_filter({array}, lambda {var}: {condition})"

    def each(self, array: str, var: str, value: str) -> str:
        return f"transform({array}, {var} -> {value})" if self.spark else f"list_transform({array}, lambda {var}: {value})"

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"len({array})"

    def unique(self, array: str) -> str:
        return f"array_distinct({array})" if self.spark else f"list_distinct({array})"

    def shared(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})" if self.spark else f"list_intersect({a}, {b})"

    def has(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})" if self.spark else f"list_contains({array}, {x})"

    def overlap(self, array: str, values) -> str:
        items = ", ".join(quote(x) for x in values)
        return f"arrays_overlap({array}, array({items}))" if self.spark else f"list_has_any({array}, [{items}])"

    def joined(self, array: str, sep: str) -> str:
        return f"array_join({array}, {quote(sep)})" if self.spark else f"coalesce(array_to_string({array}, {quote(sep)}), '')"

    def bytes(self, x: str) -> str:
        return f"octet_length({x})" if self.spark else f"strlen({x})"

    def trimmed(self, x: str, signs: str) -> str:
        return f"trim(BOTH {quote(signs)} FROM {x})" if self.spark else f"trim({x}, {quote(signs)})"


SPARK, OTHER = Dialect("spark"), Dialect("duckdb")


# Text.
def tokens_of(text: str, d: Dialect) -> str:
    """Lower-case runs of letters and digits."""
    return d.keep(d.split(f"lower({text})", r"[^\p{L}\p{Nd}]+"), "t", "t <> ''")


def title_words(title: str, d: Dialect) -> str:
    """Words of a title without signs and stop words."""
    bare = d.replaced(f"lower({title})", r"[^\p{L}\p{Nd}\s]", "")
    return d.keep(d.split(bare, r"\s+"), "t", f"t <> '' AND t NOT IN ({listed(v.STOP_WORDS)})")


def title_tokens(title: str, d: Dialect) -> str:
    """Distinct ASCII letter and digit runs of a title; stop words stay."""
    return d.unique(d.keep(d.split(f"lower({title})", r"[^a-z0-9]+"), "t", "t <> ''"))


def estimated_tokens(text: str, d: Dialect) -> str:
    n = d.bytes(text)
    return f"cast(floor(({n} + 3) / 4.0e0) AS bigint)"


def effective_tokens(d: Dialect) -> str:
    return f"(CASE WHEN token_count > 0 THEN cast(token_count AS bigint) ELSE {estimated_tokens('text', d)} END)"


def any_of(x: str, cues) -> str:
    """Whether a text contains one of the cues."""
    return "(" + " OR ".join(f"contains({x}, {quote(c)})" for c in cues) + ")"


# Edges.
def edge_token(raw: str, d: Dialect) -> str:
    return d.replaced(d.replaced(f"replace(lower({raw}), '_', '-')", r"^\s+|\s+$", ""), r"\s+", "-")


def edge_type(raw: str, d: Dialect) -> str:
    return choose(edge_token(raw, d), {k: k for k in v.EDGE_WEIGHTS} | v.EDGE_ALIASES, "'related-to'")


def edge_known(raw: str, d: Dialect) -> str:
    return f"({edge_token(raw, d)} IN ({listed([*v.EDGE_WEIGHTS, *v.EDGE_ALIASES])}))"


def edge_note(raw: str, note: str, d: Dialect) -> str:
    return f"(CASE WHEN {raw} <> '' AND {raw} <> {edge_type(raw, d)} AND {note} = '' THEN concat('raw_type=', {raw}) ELSE {note} END)"


def edge_weight(kind: str) -> str:
    return choose(kind, v.EDGE_WEIGHTS, number(v.OTHER_WEIGHT))


def backlog_edge_name(raw: str) -> str:
    token = f"replace(trim(replace(lower({raw}), '_', '-')), ' ', '-')"
    return choose(token, v.BACKLOG_EDGE_NAMES, token)


def backlog_edge_weight(kind: str) -> str:
    return choose(kind, v.BACKLOG_EDGE_WEIGHTS, number(v.OTHER_WEIGHT))


# Single scores.
def authority_parts() -> str:
    return f"""{clamp(
        f"0.35e0 * {clamp('trust')} + 0.20e0 * cites + 0.20e0 * approved + 0.15e0 * " + choose("chunk_type", v.CHUNK_AUTHORITY, "0.0e0") + " + 0.10e0 * " + version_currentness()
    )}"""


def version_currentness() -> str:
    return "(CASE WHEN superseded_by <> '' THEN 0.0e0 WHEN version = '' THEN 0.5e0 ELSE 1.0e0 END)"


def length_fit(tokens: str, budget: str) -> str:
    share = f"{tokens} / cast({budget} AS double)"
    return f"(CASE WHEN {budget} <= 0 THEN 0.25e0 WHEN {share} <= 0.08e0 THEN 1.0e0 WHEN {share} <= 0.15e0 THEN 0.8e0 WHEN {share} <= 0.25e0 THEN 0.55e0 ELSE 0.25e0 END)"


def freshness(now_year: int) -> str:
    age = f"({now_year} - year)"
    return f"(CASE WHEN year = 0 THEN 0.65e0 WHEN {age} <= 2 THEN 0.90e0 WHEN {age} <= 7 THEN 0.80e0 WHEN contains(lower(concat(type, ' ', notes)), 'classic') THEN 0.82e0 ELSE greatest(0.25e0, 1.0e0 - {age} / 24.0e0) END)"


def stale_hype(now_year: int) -> str:
    age, text = f"({now_year} - year)", "lower(concat(title, ' ', notes))"
    return f"(year > 0 AND (({age} >= 7 AND ({any_of(text, v.HYPE_CUES)} OR recommended_count >= 3)) OR ({age} >= 12 AND contains({text}, 'current'))))"


def is_overview() -> str:
    return any_of("lower(concat(type, ' ', title, ' ', notes))", v.OVERVIEW_CUES)


def energy_time_fit(goal_energy: str, goal_minutes: str) -> str:
    budget = f"(CASE WHEN {goal_minutes} <= 0 THEN 90 ELSE {goal_minutes} END)"
    time = f"(CASE WHEN length_minutes > {budget} THEN greatest(0.2e0, {budget} / cast(length_minutes AS double)) ELSE 1.0e0 END)"
    g, i = f"lower({goal_energy})", "lower(energy)"
    energy_fit = f"(CASE WHEN {g} = '' OR {i} = '' THEN 0.8e0 WHEN {g} = {i} THEN 1.0e0 WHEN {g} = 'low' AND ({i} = 'high' OR difficulty >= 4) THEN 0.35e0 ELSE 0.7e0 END)"
    return clamp(f"{time} * 0.55e0 + {energy_fit} * 0.45e0")


def goal_terms(prompt: str, d: Dialect) -> str:
    """Terms of a prompt that count: over three bytes, without surrounding punctuation."""
    words = d.each(d.split(f"lower({prompt})", r"\s+"), "t", d.trimmed("t", " ,.;:!?()[]{}\"'"))
    return d.keep(words, "t", f"{d.bytes('t')} > 3")


def goal_fit(terms: str, text: str, d: Dialect) -> str:
    return goal_fit_of(d.size(d.keep(terms, "t", f"contains({text}, t)")))


def goal_fit_of(n: str) -> str:
    """The fit of a node that holds n of the terms."""
    return f"(CASE WHEN goal_fit > 0 THEN {clamp('goal_fit')} WHEN {n} = 0 THEN 0.1e0 ELSE {clamp(f'0.35e0 + {n} * 0.18e0')} END)"


def low_trust() -> str:
    return f"(CASE WHEN trust >= 0.35e0 THEN 0.0e0 ELSE {clamp('1.0e0 - trust / 0.35e0')} END)"


# Access.
def sensitivity_level(x: str) -> str:
    return choose(x, v.SENSITIVITIES, "3")


def clearance_level(x: str) -> str:
    return choose(x, v.CLEARANCES, "0")


def denial(d: Dialect, tenant: str = "caller_tenant", approvers: str = "trusted_approvers", clearance: str = "clearance", unapproved: str = "allow_unapproved") -> str:
    """Why a caller can't see a node; null if it can."""
    q = "concat('node sensitivity \"', sensitivity, '\" exceeds caller clearance \"', " + clearance + ", '\"')"
    some = f"{d.size(d.shared('approved_by', approvers))} > 0"
    return f"""(CASE
        WHEN tenant_id <> '' AND tenant_id <> {tenant} THEN concat('node tenant "', tenant_id, '" does not match caller tenant')
        WHEN {sensitivity_level('sensitivity')} > {clearance_level(clearance)} THEN {q}
        WHEN {sensitivity_level('sensitivity')} >= 2 AND {d.size('approved_by')} > 0 AND NOT ({some}) THEN 'confidential or restricted node lacks a trusted approver for caller'
        WHEN chunk_type IN ({listed(v.CONTROLLING_CHUNKS)}) AND {d.size('approved_by')} = 0 AND NOT {unapproved} THEN concat(chunk_type, ' node lacks required approval')
    END)"""


# Ranking and packing.
def positive() -> str:
    parts = "0.28e0 * query_relevance + 0.18e0 * authority + 0.14e0 * graph_importance + 0.10e0 * readiness + 0.10e0 * freshness + 0.10e0 * token_fit + 0.05e0 * diversity + 0.03e0 * bridge_bonus + 0.02e0 * counterpoint_bonus"
    return f"({parts} + CASE WHEN query_type = 'Temporal' THEN 0.08e0 * freshness ELSE 0.0e0 END)"


def negative() -> str:
    return "(0.14e0 * redundancy + 0.10e0 * staleness + 0.08e0 * low_trust + CASE WHEN query_type = 'Adversarial' THEN 0.08e0 * low_trust ELSE 0.0e0 END)"


def modifier() -> str:
    return """(CASE
        WHEN query_type = 'Factual' AND role = 'foundation' THEN 8.0e0
        WHEN query_type = 'Comparative' AND role IN ('bridge', 'counterpoint') THEN 8.0e0
        WHEN query_type = 'Procedural' AND chunk_type = 'procedure' THEN 12.0e0
        WHEN query_type = 'Procedural' AND chunk_type = 'permission-record' THEN 6.0e0
        WHEN query_type = 'Exploratory' AND role = 'overview' THEN 12.0e0
        WHEN query_type = 'Exploratory' AND role = 'bridge' THEN 8.0e0
        WHEN query_type = 'Adversarial' AND role = 'counterpoint' THEN 15.0e0
        WHEN query_type = 'Agentic' AND chunk_type = 'permission-record' THEN 20.0e0
        WHEN query_type = 'Agentic' AND chunk_type = 'decision' THEN 15.0e0
        WHEN query_type = 'Agentic' AND chunk_type = 'procedure' THEN 12.0e0
        ELSE 0.0e0 END)"""


def total_score(plus: str = "positive", minus: str = "negative", bonus: str = "modifier") -> str:
    """From the three columns above."""
    points = f"({clamp(f'{plus} - {minus}')} * 100.0e0 + {bonus})"
    return rounded(f"{clamp(f'{points} / 100.0e0')} * 100.0e0", 1)


def slot_type() -> str:
    return """(CASE WHEN chunk_type = 'permission-record' THEN 'permission' WHEN chunk_type = 'decision' THEN 'decision'
        WHEN chunk_type = 'procedure' THEN 'procedure' WHEN chunk_type = 'community-summary' THEN 'overview'
        WHEN role IN ('overview', 'foundation', 'bridge', 'counterpoint') THEN role ELSE 'support' END)"""


def slot_limit(which: int) -> str:
    """The largest (1) or least (0) count of slot_type under query_type; null if not allowed."""
    def row(limits) -> dict:
        return {s: x[which] for s, x in zip(v.SLOT_TYPES, limits, strict=True) if x}

    support = v.SUPPORT_MAX if which else 0
    named = " ".join(f"WHEN {quote(q)} THEN {choose('slot_type', row(x) | {'support': support}, 'NULL')}" for q, x in v.SLOT_LIMITS.items())
    return f"(CASE query_type {named} ELSE {choose('slot_type', row(v.SLOT_LIMITS['Factual']) | {'support': support}, 'NULL')} END)"


def slot_position() -> str:
    return """(CASE WHEN query_type = 'Agentic' AND slot_type = 'permission' THEN 'front'
        WHEN slot_type IN ('foundation', 'procedure') THEN 'front' WHEN slot_type = 'decision' THEN 'back'
        WHEN slot_type = 'counterpoint' AND query_type IN ('Adversarial', 'Comparative', 'Agentic') THEN 'back'
        WHEN slot_type = 'bridge' AND query_type = 'Comparative' THEN 'front' ELSE 'middle' END)"""


def slot_priority() -> str:
    return """(CASE WHEN query_type = 'Agentic' AND slot_type = 'permission' THEN 0
        WHEN query_type = 'Agentic' AND slot_type = 'foundation' THEN 1
        WHEN query_type = 'Agentic' AND slot_type = 'procedure' THEN 2
        WHEN query_type = 'Exploratory' AND slot_type = 'overview' THEN 0
        WHEN query_type = 'Comparative' AND slot_type = 'bridge' THEN 1 ELSE 3 END)"""


def historical(query: str) -> str:
    return any_of(f"lower({query})", v.HISTORY_CUES)


# Routing.
def route(d: Dialect) -> list[tuple[str, str, str, int, str]]:
    """Rules in order: condition, query type, mode, budget and reason (SQL); first match wins.

    They read the columns toks and norm (tokens, and these joined), and the metadata.
    """
    r = v
    year = f"{d.size(d.keep('toks', 't', year_token('t', d)))} > 0"
    hybrid, local, chain = "HybridBM25Dense", "LocalNeighborhood", "DRIFTChain"
    return [
        (f"(has_permission OR has_decision_basis) AND {d.overlap('toks', r.ACTION_VERBS)}", "Agentic", chain, 6000, quote("permission or decision-basis metadata with action verb")),
        (f"{d.overlap('toks', r.TEMPORAL_CUES)} OR {year} OR contains(norm, 'as of')", "Temporal", hybrid, 4500, quote("temporal cue")),
        (f"{any_of('norm', r.PROCEDURAL_PHRASES)} OR {d.overlap('toks', r.PROCEDURAL_CUES)}", "Procedural", local, 5000, quote("procedural cue")),
        (f"{d.overlap('toks', r.COMPARISON_CUES)} OR {any_of('norm', r.COMPARISON_PHRASES)}", "Comparative", chain, 5500, quote("comparison cue")),
        (f"{any_of('norm', r.ADVERSARIAL_PHRASES)} OR {d.overlap('toks', r.ADVERSARIAL_CUES)}", "Adversarial", chain, 6000, quote("adversarial or safety cue")),
        ("entity <> ''", "Factual", local, 3500, "concat('exact entity match: ', entity)"),
        (f"topic_span > 3 OR {any_of('norm', r.BROAD_PHRASES)}", "Exploratory", "GlobalGraph", 6500, quote("broad sensemaking or topic span")),
        (f"{d.size('toks')} <= 8", "Factual", hybrid, 3000, quote("short query without entity match")),
        ("true", "Factual", hybrid, 4000, quote("fallback factual hybrid retrieval")),
    ]


def year_token(t: str, d: Dialect) -> str:
    test = r"^(19|20|21)[0-9][0-9]$"
    return f"{t} RLIKE {d.pattern(test)}" if d.spark else f"regexp_matches({t}, {quote(test)})"


def routed(d: Dialect, what: int) -> str:
    """A field of the first matching rule: 1 type, 2 mode, 3 budget, 4 reason."""
    shown = lambda x: quote(x) if what in (1, 2) else str(x)
    rules = route(d)
    return "(CASE " + " ".join(f"WHEN {x[0]} THEN {shown(x[what])}" for x in rules[:-1]) + f" ELSE {shown(rules[-1][what])} END)"
