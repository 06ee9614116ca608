"""Reading backlogs: items and edges from JSON or from one CSV with both kinds of rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import expressions as x
from plumbline.functions.expressions import SPARK

ITEM = "id string, title string, authors array<string>, source string, year int, type string, url string, length_minutes int, difficulty int, status string, topics array<string>, notes string, goal_fit double, energy string, density string, trust double, recommended_count int"
EDGE = "source_id string, target_id string, type string, confidence double, note string"
GOAL = "prompt string, topics array<string>, familiarity int, energy string, time_minutes int, desired_depth string"
SLUG_BYTES = 28
#: Rows that one task numbers; monotonically increasing ids leave gaps only between partitions.
STRETCH = 1 << 20


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f.replace(" ", ": ", 1) for f in fields.split(", ")) + ">"


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, edges and goal of a JSON object, or of a bare list of items."""
    doc = spark.read.schema(f"items array<{_struct(ITEM)}>, edges array<{_struct(EDGE)}>, goal {_struct(GOAL)}").json(path, multiLine=True)
    listed = doc.where("items IS NOT NULL").limit(1).count() == 0
    if listed:
        rows = spark.read.schema(ITEM).json(path, multiLine=True).where("id IS NOT NULL OR title IS NOT NULL").withColumn("pos", F.monotonically_increasing_id())
        return *normalised(rows, spark.createDataFrame([], EDGE)), spark.createDataFrame([], GOAL)
    items = doc.select(F.posexplode("items").alias("pos", "i")).select("pos", "i.*")
    return *normalised(items, doc.selectExpr("inline(edges)")), doc.where("goal IS NOT NULL").select("goal.*")


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items and edges of a CSV file. Of alias columns the first that is in the header counts."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, multiLine=True)
    names = {c.strip().lower(): c for c in raw.columns}
    if raw.limit(1).count() == 0:
        raise ValueError("csv needs a header and at least one row")

    def get(*aliases: str) -> str:
        column = next((names[a] for a in aliases if a in names), None)
        return "''" if column is None else f"coalesce(trim(`{column}`), '')"

    whole = lambda *a: f"coalesce(try_cast({get(*a)} AS int), 0)"
    real = lambda *a: f"coalesce(try_cast({get(*a)} AS double), 0.0e0)"
    items = lambda *a: f"filter(transform(split({get(*a)}, '[;|,]'), t -> trim(t)), t -> t <> '')"
    edge = f"(lower({get('record_type', 'kind')}) = 'edge' OR ({get('edge_type', 'type')} <> '' AND {get('source_id')} <> '' AND {get('target_id')} <> ''))"
    rows = raw.withColumn("__pos", F.monotonically_increasing_id())
    found = rows.where(f"NOT {edge}").selectExpr(
        "__pos AS pos", *(f"{get(n)} AS {n}" for n in ("id", "title", "source", "type", "url", "status", "notes", "energy", "density")), f"{whole('year')} AS year",
        f"{whole('length_minutes', 'minutes', 'length')} AS length_minutes", f"{whole('difficulty')} AS difficulty", f"{real('goal_fit')} AS goal_fit", f"{real('trust')} AS trust",
        f"{whole('recommended_count', 'recommendations')} AS recommended_count", f"{items('authors', 'creators')} AS authors", f"{items('topics', 'tags')} AS topics",
    )
    edges = rows.where(edge).selectExpr(f"{get('source_id')} AS source_id", f"{get('target_id')} AS target_id", f"{get('edge_type', 'type')} AS type", f"{real('confidence')} AS confidence", "'' AS note")
    return normalised(found, edges)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items and edges by the file's extension, or by its first sign."""
    head = spark.read.text(path).select(F.expr("left(trim(value), 1) AS c")).where("c <> ''").first()
    if head is None:
        raise ValueError("empty backlog")
    if os.path.splitext(path)[1].lower() == ".json" or head["c"] == "{":
        return read_json(spark, path)[:2]
    return read_csv(spark, path)


def slug() -> str:
    """An id from a title and a row's place (from 1), cut to the whole characters of SLUG_BYTES bytes."""
    words = f"array_join({x.title_words('title', SPARK)}, '-')"
    cut = f"substring({words}, 1, aggregate(sequence(1, {SLUG_BYTES}), 0, (n, i) -> CASE WHEN octet_length(substring({words}, 1, i)) <= {SLUG_BYTES} THEN i ELSE n END))"
    return f"concat(CASE WHEN {words} = '' THEN 'item' ELSE {cut} END, '-', place)"


def placed(items: DataFrame) -> DataFrame:
    """items with place (from 1) in the order of pos, a long.

    pos is dense within a stretch of STRETCH, or nearly so; stretches are counted, and only
    within one of them rows are numbered in one task.
    """
    rows = items.withColumn("stretch", F.expr(f"cast(pos AS bigint) div {STRETCH}"))
    sizes = rows.groupBy("stretch").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = Window.partitionBy("stretch").orderBy("pos")
    return rows.withColumn("at", F.row_number().over(own)).join(before, "stretch").withColumn("place", (F.col("before") + F.col("at")).cast("int")).drop("stretch", "before", "at")


def normalised(items: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Defaults and limits of items (with pos, their place in the input) and edges."""
    for name in ("id", "title", "source", "type", "url", "status", "notes", "energy", "density"):
        items = items.withColumn(name, F.coalesce(F.col(name), F.lit("")))
    items = placed(items) if "place" not in items.columns else items
    out = items.selectExpr(
        "CASE WHEN trim(id) = '' THEN " + slug() + " ELSE trim(id) END AS id", "title", "coalesce(authors, cast(array() AS array<string>)) AS authors", "source", "coalesce(year, 0) AS year", "type", "url",
        "CASE WHEN coalesce(length_minutes, 0) = 0 THEN 45 ELSE length_minutes END AS length_minutes", "CASE WHEN coalesce(difficulty, 0) = 0 THEN 3 ELSE greatest(1, least(5, difficulty)) END AS difficulty",
        "CASE WHEN status = '' THEN 'unread' ELSE status END AS status", "coalesce(topics, cast(array() AS array<string>)) AS topics", "notes", "coalesce(goal_fit, 0.0e0) AS goal_fit", "energy", "density",
        f"{x.clamp('coalesce(trust, 0.0e0)')} AS trust", "coalesce(recommended_count, 0) AS recommended_count",
    )
    links = edges.selectExpr("source_id", "target_id", f"{x.backlog_edge_name('type')} AS type", "CASE WHEN coalesce(confidence, 0.0e0) = 0 THEN 1.0e0 ELSE confidence END AS confidence", "coalesce(note, '') AS note")
    return out, links


def item_errors(items: DataFrame) -> DataFrame:
    """id and error of items without title and of ids that occur again."""
    untitled = items.where("title = ''").selectExpr("id", "'item is missing title' AS error")
    return untitled.unionByName(items.groupBy("id").count().where("count > 1").selectExpr("id", "'duplicate item id' AS error"))


def as_nodes(items: DataFrame) -> DataFrame:
    """Items as graph nodes: internal documents whose text is their notes."""
    return items.selectExpr("*", "notes AS text", "'document' AS chunk_type", f"{x.estimated_tokens('notes', SPARK)} AS token_count", "'internal' AS sensitivity")


def as_items(nodes: DataFrame) -> DataFrame:
    """Nodes as items: notes are the text where there are none."""
    names = [f.split(" ")[0] for f in ITEM.split(", ")]
    return nodes.selectExpr(*("CASE WHEN notes = '' THEN text ELSE notes END AS notes" if n == "notes" else n for n in names if n in nodes.columns))
