"""Names, weights, cues and policies that results depend on."""

from __future__ import annotations

#: Edge types with their weights.
EDGE_WEIGHTS = {
    "prerequisite": 1.50,
    "supersedes": 1.40,
    "decision-basis": 1.35,
    "approved-by": 1.30,
    "overview": 1.25,
    "evidence-for": 1.20,
    "evidence-against": 1.20,
    "implements": 1.20,
    "exception-to": 1.15,
    "cites": 1.10,
    "applies-to": 1.10,
    "version-of": 1.00,
    "contradicts": 1.00,
    "community-member-of": 0.90,
    "same-question": 0.80,
    "owned-by": 0.70,
    "related-to": 0.60,
    "duplicate": 0.20,
}
OTHER_WEIGHT = 0.60

#: Other names of edge types.
EDGE_ALIASES = {
    "prereq": "prerequisite",
    "requires": "prerequisite",
    "updates": "supersedes",
    "replaces": "supersedes",
    "supersedes-version": "supersedes",
    "basis": "decision-basis",
    "decided-from": "decision-basis",
    "approved": "approved-by",
    "reviewed-by": "approved-by",
    "review": "overview",
    "surveys": "overview",
    "primer-for": "overview",
    "supports": "evidence-for",
    "proves": "evidence-for",
    "refutes": "evidence-against",
    "opposes": "evidence-against",
    "implements-policy": "implements",
    "satisfies": "implements",
    "exempts": "exception-to",
    "waives": "exception-to",
    "mentions": "cites",
    "mention": "cites",
    "governs": "applies-to",
    "covers": "applies-to",
    "revision-of": "version-of",
    "variant-of": "version-of",
    "counterpoint": "contradicts",
    "responds-to": "contradicts",
    "in-community": "community-member-of",
    "cluster-member": "community-member-of",
    "same-topic": "same-question",
    "similar": "same-question",
    "owner": "owned-by",
    "maintained-by": "owned-by",
    "relates": "related-to",
    "associated-with": "related-to",
    "duplicates": "duplicate",
    "duplicate-of": "duplicate",
    "dupe": "duplicate",
}

#: Names that backlog edges are brought to; other names stay.
BACKLOG_EDGE_NAMES = {
    "same-topic": "same-question",
    "similar": "same-question",
    "duplicates": "duplicate",
    "duplicate-of": "duplicate",
    "dupe": "duplicate",
    "counterpoint": "contradicts",
    "responds-to": "contradicts",
    "mentions": "cites",
    "mention": "cites",
    "prereq": "prerequisite",
    "requires": "prerequisite",
    "review": "overview",
    "surveys": "overview",
}
BACKLOG_EDGE_WEIGHTS = {
    "prerequisite": 1.50,
    "cites": 1.10,
    "overview": 1.25,
    "contradicts": 1.00,
    "same-question": 0.80,
    "duplicate": 0.20,
}

CHUNK_AUTHORITY = {
    "permission-record": 1.00,
    "decision": 0.95,
    "procedure": 0.90,
    "definition": 0.85,
    "document": 0.80,
    "section": 0.75,
    "community-summary": 0.70,
    "claim": 0.65,
    "chunk": 0.60,
    "entity": 0.55,
}
CONTROLLING_CHUNKS = ("permission-record", "decision", "procedure")
SENSITIVITIES = {"public": 0, "": 1, "internal": 1, "confidential": 2, "restricted": 3}
CLEARANCES = {"public": 0, "": 1, "internal": 1, "confidential": 2, "restricted": 3}
CLEARANCE_OF_ROLE = {
    "super_admin": "restricted",
    "tenant_admin": "restricted",
    "governance_lead": "confidential",
    "operator": "confidential",
    "auditor": "internal",
    "viewer": "internal",
}

STOP_WORDS = ("the", "a", "an", "and", "of", "to", "for", "in", "on")
OVERVIEW_CUES = ("review", "overview", "survey", "primer", "introduction", "guide", "handbook")
HYPE_CUES = ("hype", "trend", "hot take", "breakthrough")
HISTORY_CUES = ("historical", "history", "old", "as of")

ACTION_VERBS = ("create", "issue", "approve", "delete", "send", "change", "execute", "deploy", "grant", "revoke", "purchase", "refund", "file")
TEMPORAL_CUES = ("current", "latest", "today", "changed", "new", "old", "superseded", "version")
PROCEDURAL_CUES = ("steps", "runbook", "procedure", "workflow", "sop", "troubleshoot")
PROCEDURAL_PHRASES = ("how do i",)
COMPARISON_CUES = ("compare", "versus", "vs", "tradeoff", "difference")
COMPARISON_PHRASES = ("which is better",)
ADVERSARIAL_CUES = ("risk", "allowed", "not", "never", "forbidden", "exception", "counterexample")
ADVERSARIAL_PHRASES = ("should i", "is it safe", "can i")
BROAD_PHRASES = ("what are the themes", "summarize", "overview", "map", "explain the landscape")

QUERY_TYPES = ("Factual", "Comparative", "Procedural", "Exploratory", "Temporal", "Adversarial", "Agentic")
SLOT_TYPES = ("overview", "foundation", "bridge", "counterpoint", "procedure", "permission", "decision")
#: By query type, (min, max) of each slot type in the order above; None: not allowed.
SLOT_LIMITS = {
    "Factual": ((0, 1), (1, 3), (0, 1), (0, 1), None, (0, 1), (0, 1)),
    "Comparative": ((0, 1), (2, 4), (1, 2), (1, 1), None, (0, 1), (0, 1)),
    "Procedural": ((0, 1), (1, 2), (0, 1), (0, 1), (1, 3), (0, 1), (0, 1)),
    "Exploratory": ((1, 3), (0, 2), (1, 3), (0, 1), None, None, (0, 1)),
    "Temporal": ((0, 1), (1, 3), (0, 1), (0, 1), None, (0, 1), (0, 1)),
    "Adversarial": ((0, 1), (1, 3), (0, 1), (1, 2), (0, 1), (0, 1), (0, 1)),
    "Agentic": ((0, 1), (1, 2), (0, 1), (0, 1), (1, 3), (1, 2), (1, 2)),
}
SUPPORT_MAX = 99
