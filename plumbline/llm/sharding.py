"""Shards by a hierarchical weighted hash tree, with gapless slots.

A row descends from region to rack to shard. At each level every child draws -ln(u) / weight
with u a hash of the row's key and the child's name, and the smallest draw wins. So a child
gets its share of the weights, and a change of weights moves rows only into or out of the
subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, unit_hash

#: A shard's slots are numbered in so many parts, each by a task of its own.
PARTS = 256
#: Equal rows that are made from one row at a time.
COPIES = 1 << 16


@dataclass(frozen=True)
class Leaf:
    """A shard, its place in the tree and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = 40, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """The layout for a number of shards: base shards in regions of racks, then one region each.

    As a further shard is a region of its own, no weight inside an older region changes:
    one more shard takes rows into itself only.
    """
    leaves = []
    for s in range(min(shards, base)):
        region = s // (racks * per_rack)
        leaves.append(Leaf(f"r{region}", f"k{s // per_rack % racks}", s))
    return leaves + [Leaf(f"x{s}", "k0", s) for s in range(base, shards)]


def _draw(key: Column, children: dict[str, list[tuple[str, float]]], path: Column) -> Column:
    """The child of path with the smallest draw; children: by path, names and weights."""
    listed = []
    for parent, own in children.items():
        weighed = [F.struct(F.lit(name).alias("name"), F.lit(float(w)).alias("weight")) for name, w in own if w > 0]
        listed += [F.lit(parent), F.array(*weighed)]

    def draw(child: Column) -> Column:
        u = (unit_hash(key, path, child["name"]) + 1) / F.lit(2.0**60)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(F.element_at(F.create_map(*listed), path), draw))["name"]


def descend(rows: DataFrame, leaves: list[Leaf], key: Column, out: str) -> DataFrame:
    """rows with the shard of each in column out."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for x in leaves:
        names = ["", x.region, f"{x.region}/{x.rack}", str(x.shard)]
        for level, (parent, name) in zip(levels, pairwise(names), strict=True):
            own = level.setdefault(parent, {})
            own[name] = own.get(name, 0.0) + x.weight
    at = F.lit("")
    for depth, level in enumerate(levels):
        name = f"__{out}_{depth}"
        rows = rows.withColumn(name, _draw(key, {p: list(c.items()) for p, c in level.items()}, at))
        at = F.col(name)
    return rows.withColumn(out, at.cast("int")).drop(*(f"__{out}_{d}" for d in range(3)))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    The law is `key`: id and number of shards decide. grown_shard is the shard among one
    more. size is the text's UTF-8 bytes plus 16. A shard's slots run from 0 without a gap,
    by parts of the shard and by id, size and checksum in each. Null text counts as empty, a
    very long one as any; null ids are one key; rows with one id share a shard and have a slot
    each; rows that are equal in all of these are counted before they meet; an empty table
    gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = descend(descend(rows, tree(shards), key, "shard"), tree(shards + 1), key, "grown_shard")
    rows = rows.withColumn("part", (unit_hash(key, F.col("size").cast("string"), F.col("text_crc32").cast("string")) % parts).cast("int"))
    # Read twice: for the parts' sizes, and for the slots.
    rows = Scratch(docs.sparkSession, "shards").store(rows, "placed")
    sizes = rows.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * parts rows, whatever the input: small enough to broadcast.
    first = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(own), F.lit(0))).join(F.broadcast(first), ["shard", "part"])
    rows = rows.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")))
    rows = rows.withColumn("copy", F.explode(F.expr(f"sequence(from, least(n, from + {COPIES}L) - 1)")))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("at") + F.col("copy")).cast("long").alias("slot"), "grown_shard",
    )
