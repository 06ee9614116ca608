"""Rendering of results as JSON documents and as text."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ranking

#: How a missing time is written.
NO_TIME = "0001-01-01T00:00:00Z"


def indented(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def json_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Each row as one JSON document, with nulls written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(column))


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def role_lines(rows: DataFrame) -> DataFrame:
    """One line a unread item; rows: query_nodes()."""
    return rows.where("lower(status) <> 'read'").selectExpr("query_id", "id", "concat('- ', id, ': ', role, ' — ', title) AS line")


def score_lines(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("query_id", "backlog_total", "id", "format_string('%5.1f  %-14s %-14s %s', backlog_total, role, id, title) AS line")


def queue_lines(rows: DataFrame, budget: int = 180, limit: int = 5) -> DataFrame:
    """Lines of what to read next and, with chosen false, of what waits and why."""
    queue = ranking.reading_queue(rows, budget, limit).join(rows.selectExpr("query_id", "id", "title", "role", "backlog_total", f"{ranking.explanation()} AS why"), ["query_id", "id"])
    reason = "CASE WHEN role = 'duplicate' THEN 'duplicate or redundant' WHEN minutes > 0 THEN 'outside this queue after stronger fits' ELSE 'lower priority for this goal' END"
    return queue.selectExpr(
        "query_id", "place", "chosen",
        f"CASE WHEN chosen THEN format_string('%d. %s (%s, %d min, score %.1f)\\n   Why: %s', row_number() OVER (PARTITION BY query_id, chosen ORDER BY place), title, role, minutes, backlog_total, why) ELSE concat('- ', title, ': ', {reason}) END AS line",
    )


def listed(ids: list[str] | None) -> str:
    return ", ".join(ids) if ids else "none"


def clusters(groups: list[list[str]] | None) -> str:
    return "; ".join(f"[{', '.join(g)}]" for g in groups) if groups else "none"


def hygiene_text(report: dict) -> str:
    """A report's row as text."""
    return f"""Backlog hygiene
Duplicate clusters: {clusters(report.get('duplicate_clusters'))}
Orphan items: {listed(report.get('orphan_nodes'))}
Stale/hype cautions: {listed(report.get('stale_nodes'))}
Missing prerequisite bridges: {listed(report.get('missing_bridges'))}
"""


def hygiene_json(report: dict) -> str:
    """Lists that were never filled are null, but clusters and stale nodes are empty lists."""
    keys = ("missing_bridges", "missing_edges")
    out = {"duplicate_clusters": report.get("duplicate_clusters") or [], "orphan_nodes": report.get("orphan_nodes") or None, "stale_nodes": report.get("stale_nodes") or []}
    out |= {k: report.get(k) or None for k in keys} | {"score": report["score"], "signal": report["signal"]}
    return indented(out)


def markdown_report(queue: list[str], roles: list[str], report: dict) -> str:
    """The whole report of a backlog; queue and roles are lines."""
    return "\n".join(["# Reading report", "", "## Read next", *queue, "", "## Roles", *roles, "", "## Hygiene", *(f"- {line}" for line in hygiene_text(report).splitlines()[1:])]) + "\n"
