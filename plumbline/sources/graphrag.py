"""Importing community-graph exports: seven tables become nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "documents": "id string, human_readable_id string, title string, text string, period string",
    "text_units": "id string, human_readable_id string, document_id string, text string, n_tokens int, community_id string, period string",
    "entities": "id string, human_readable_id string, title string, description string, community_id string, text_unit_ids array<string>, period string",
    "relationships": "id string, source string, target string, source_id string, target_id string, description string, weight double",
    "community_reports": "id string, human_readable_id string, community string, title string, summary string, full_content string, rank double, period string",
    "communities": "id string, human_readable_id string, community string, title string, entity_ids array<string>, text_unit_ids array<string>, report_id string",
    "covariates": "id string, human_readable_id string, subject_id string, text_unit_id string, claim string, status string, period string, evidence_ids array<string>",
}
SOURCE, TRUST = "graphrag", 0.75


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split(" ", 1)) for f in schema.split(", ")]


def shaped(df: DataFrame | None, name: str, spark: SparkSession) -> DataFrame:
    """A table with exactly its schema's columns; what is missing or of another type is empty."""
    if df is None:
        return spark.createDataFrame([], SCHEMAS[name])
    kinds = dict(df.dtypes)
    out = []
    for column, kind in _fields(SCHEMAS[name]):
        empty = {"string": "''", "int": "0", "double": "0.0e0"}.get(kind, "cast(array() AS array<string>)")
        have = kinds.get(column)
        if have is None or kind.startswith("array") != have.startswith("array"):
            out.append(f"{empty} AS {column}")
        else:
            out.append(f"coalesce({'try_cast' if not kind.startswith('array') else 'cast'}({column} AS {kind}), {empty}) AS {column}")
    return df.selectExpr(*out)


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One export document: (query_id, query), nodes and edges."""
    fields = ", ".join(f"{n} array<struct<{', '.join(f'{c}: {k}' for c, k in _fields(s))}>>" for n, s in SCHEMAS.items())
    doc = spark.read.schema(f"query_id string, query string, {fields}").json(path, multiLine=True)
    tables = {n: doc.selectExpr(f"inline({n})") for n in SCHEMAS}
    return doc.selectExpr("coalesce(query_id, '') AS query_id", "coalesce(query, '') AS query"), *mapped(tables)


def read_parquet(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Tables by name, any of the seven; entities' text unit ids aren't used."""
    return mapped({n: spark.read.parquet(p) for n, p in paths.items()})


def period(column: str = "period") -> str:
    return f"""coalesce(try_to_timestamp({column}, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"), try_to_timestamp({column}, 'yyyy-MM-dd'), try_to_timestamp({column}, 'yyyy-MM'), try_to_timestamp({column}, 'yyyy'))"""


def mapped(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an export's tables."""
    spark = next(iter(tables.values())).sparkSession
    t = {n: shaped(tables.get(n), n, spark) for n in SCHEMAS}

    def nodes(df: DataFrame, chunk: str, title: str, text: str, *, community: str = "''", tokens: str = "0", document: str = "''", kind: str = "''", rank: str | None = None) -> DataFrame:
        more = f", 'community_report_rank', {rank}" if rank else ""
        return df.selectExpr(
            "id", f"{title} AS title", f"{text} AS text", f"{text} AS notes", f"'{SOURCE}' AS source", f"'{SOURCE}' AS origin", f"{TRUST}e0 AS trust", f"{kind} AS type", f"'{chunk}' AS chunk_type",
            f"{tokens} AS token_count", "'internal' AS sensitivity", f"{community} AS community_id", f"{period()} AS observed_at", f"{document} AS document_id", f"map('human_readable_id', human_readable_id{more}) AS attributes",
        )

    # A rank's shortest decimal: whole numbers lose their '.0'.
    rank = "regexp_replace(cast(rank AS string), '[.]0$', '')"
    out = nodes(t["documents"], "document", "title", "text")
    for part in (
        nodes(t["text_units"], "chunk", "id", "text", community="community_id", tokens="n_tokens", document="document_id"),
        nodes(t["entities"], "entity", "title", "description", community="community_id"),
        nodes(t["community_reports"], "community-summary", "title", "CASE WHEN full_content = '' THEN summary ELSE full_content END", community="community", kind="'overview'", rank=rank),
        nodes(t["covariates"], "claim", "id", "claim"),
    ):
        out = out.unionByName(part)
    edge = lambda df, s, d, kind, conf, note="''": df.selectExpr(f"{s} AS source_id", f"{d} AS target_id", f"{kind} AS type", f"{conf} AS confidence", f"{note} AS note")
    against = "CASE WHEN status IN ('negative', 'false', 'disputed') THEN 'evidence-against' ELSE 'evidence-for' END"
    edges = edge(t["covariates"].selectExpr("*", "explode(evidence_ids) AS evidence"), "evidence", "id", against, "1.0e0")
    weight = "CASE WHEN weight <= 0 OR weight > 1 THEN 1.0e0 ELSE weight END"
    edges = edges.unionByName(edge(t["relationships"], "coalesce(nullif(source_id, ''), source)", "coalesce(nullif(target_id, ''), target)", "'related-to'", weight, "description"))
    for ids in ("entity_ids", "text_unit_ids"):
        members = t["communities"].selectExpr("*", f"explode({ids}) AS member")
        edges = edges.unionByName(edge(members, "member", "coalesce(nullif(report_id, ''), id)", "'community-member-of'", "0.8e0"))
    return out, edges
