"""Approximate nearest neighbours: an inverted file of product-quantised residuals.

Coarse centroids and the codebooks of residuals are trained on a bounded sample; every
vector of the table is encoded. A query looks into its nearest lists, ranks their codes by
asymmetric distance tables, and the best of these are ranked again by the exact cosine of
the original vectors. Equal vectors are one entry of the index with their smallest ids, as
only these can be among a query's nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch


@dataclass(frozen=True)
class Settings:
    """sample: training rows at most. per_list: about the vectors of a list, as long as the
    sample has per_centroid rows a list; beyond that lists grow. coverage: the share of near
    neighbours within the sample that must lie in the lists that a query looks into, and
    among the codes that are ranked exactly; it sets the numbers of both. parts: sub-vectors
    of a code, of 256 codewords each. keep: codes that are ranked exactly, per query, at
    least. block: vectors of a list that one task holds at once. fan: results merged at once.
    """

    sample: int = 20_000
    per_list: int = 512
    per_centroid: int = 32
    coverage: float = 0.98
    parts: int = 32
    keep: int = 300
    block: int = 4096
    rounds: int = 12
    fan: int = 64


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish.

    That is exact but for components too small to count beside the largest.
    """
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0))
    return np.ldexp(vectors, -exponent)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids (fewer for fewer rows) by Lloyd's rounds from random rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T - (centroids**2).sum(1) / 2, axis=1)
        order = np.argsort(own, kind="stable")
        some, start = np.unique(own[order], return_index=True)
        centroids[some] = np.add.reduceat(x[order], start) / np.diff(np.append(start, len(x)))[:, None]
    return centroids


@dataclass(frozen=True)
class Quantiser:
    """Centroids of the lists, codebooks[part] of the residuals' sub-vectors, the lists that a
    query looks into, and the codes that are ranked exactly for it."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]
    probes: int
    keep: int

    @property
    def cuts(self) -> list[slice]:
        ends = np.cumsum([c.shape[1] for c in self.codebooks]).tolist()
        return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        score = x @ self.centroids.T - (self.centroids**2).sum(1) / 2
        n = min(n, score.shape[1])
        return np.argpartition(-score, n - 1, axis=1)[:, :n]

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([np.argmax(residuals[:, c] @ b.T - (b**2).sum(1) / 2, axis=1).astype(np.uint8) for c, b in zip(self.cuts, self.codebooks, strict=True)], axis=1)

    def inner_products(self, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Of queries and the coded vectors of a list, by one table of partial products a query."""
        tables = [queries[:, c] @ b.T for c, b in zip(self.cuts, self.codebooks, strict=True)]
        out = np.repeat((queries @ self.centroids[number])[:, None], len(codes), axis=1)
        for part, table in enumerate(tables):
            out += table[:, codes[:, part]]
        return out


def train(sample: np.ndarray, rows: int, k: int, s: Settings) -> Quantiser:
    """rows: of the whole table. k: the neighbours that probes are set for."""
    x = unit(sample).astype(np.float32)
    lists = max(1, min(math.ceil(rows / s.per_list), len(x) // s.per_centroid))
    centroids = k_means(x, lists, s.rounds, 1)
    score = x @ centroids.T - (centroids**2).sum(1) / 2
    own = np.argmax(score, axis=1)
    residuals = x - centroids[own]
    books = [k_means(np.ascontiguousarray(p), 256, s.rounds, 2 + i) for i, p in enumerate(np.array_split(residuals, min(s.parts, x.shape[1]), axis=1))]
    # How many lists hold the sample's own nearest neighbours of some of its rows.
    asked = np.arange(min(500, len(x)))
    near = x[asked] @ x.T
    near[asked, asked] = -np.inf
    k = min(k, len(x) - 1)
    true = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((0, 1), int)
    rank = np.argsort(np.argsort(-score[asked], axis=1), axis=1)
    places = np.sort(np.take_along_axis(rank, own[true], 1).ravel()) if k else np.zeros(1, int)
    at = min(len(places) - 1, math.ceil(s.coverage * len(places)))
    probes = int(places[at]) + 1
    made = Quantiser(centroids, books, probes, s.keep)
    # Where these stand among the sample's codes; the whole table has so many times more.
    approximate = near.copy() if k else near
    codes = made.encode(residuals) if k else None
    for number in range(len(centroids) if k else 0):
        members = np.flatnonzero(own == number)
        approximate[:, members] = made.inner_products(x[asked], number, codes[members])
    approximate[asked, asked] = -np.inf
    found = np.take_along_axis(approximate, true, 1)
    stand = [len(x) - np.searchsorted(o, f, side="right") for o, f in zip(np.sort(approximate, axis=1), found, strict=True)]
    worst = int(np.sort(np.concatenate(stand))[at]) + 1 if k else 1
    return Quantiser(centroids, books, probes, max(s.keep, math.ceil(worst * rows / len(x))))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:  # noqa: B008
    """query_id, rank, vec_id and score (cosine, double): the k nearest found of each query.

    A query's own id is never its neighbour; ties go to the smaller id. Rows take no part
    whose id or vector is null, or whose vector is zero, holds a null, NaN or infinity, or
    is of another length than most; of very large and very small components the cosine is
    exact, too. Equal rows of one id count once; an empty table gives no rows; other columns
    are not read. Very common vectors are one entry; a very long list is searched in blocks,
    and what they return is merged fan by fan, so that no task holds more than that.
    """
    spark, s = vectors.sparkSession, settings
    scratch = Scratch(spark, "nearest")
    value = F.col(vector_col).cast("array<double>")

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), value.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        return rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")

    rows = usable(vectors)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == common["n"]).withColumn("key", F.xxhash64("v"))
    asked = scratch.store(usable(queries).where(F.size("v") == common["n"]).withColumn("key", F.xxhash64("v")).distinct(), "asked")

    # Of equal vectors, the k + 1 smallest ids; a limit a group, taken before the shuffle.
    smallest = Window.partitionBy("key", "v").orderBy("id")
    few = rows.distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    entries = scratch.store(few.groupBy("key", "v").agg(F.min("id").alias("entry"), F.array_sort(F.collect_list("id")).alias("ids")), "entries")

    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(s.sample).select("v").toArrow()
    model = train(_matrix(sample.column("v").combine_chunks()), entries.count(), k, s)
    shared = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unit(_matrix(batch.column("v"))).astype(np.float32)
                own = q.nearest_lists(x, 1)[:, 0]
                codes = q.encode(x - q.centroids[own])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("entry"), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "entry", "code"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if batch.num_rows:
                lists = q.nearest_lists(unit(_matrix(batch.column("v"))).astype(np.float32), q.probes)
                at = pa.array(np.repeat(np.arange(batch.num_rows), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), batch.column("query").take(at), batch.column("v").take(at)], ["list", "query", "v"])

    # Queries of one vector are searched once; a long list is searched in blocks.
    coded = scratch.store(entries.select("entry", "v").mapInArrow(encode, "list int, entry long, code binary"), "coded")
    blocks = coded.groupBy("list").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    placed = coded.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).drop("blocks")
    single = asked.groupBy("key", "v").agg(F.min("id").alias("query"))
    probes = single.select("query", "v").mapInArrow(probe, "list int, query long, v array<double>").join(blocks, "list")
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    most = blocks.agg(F.max("blocks")).first()[0]

    def search(codes: pa.Table, wanted: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("slot", pa.int64()), ("entries", pa.list_(pa.int64())), ("nears", pa.list_(pa.float32()))])
        if not codes.num_rows or not wanted.num_rows:
            return schema.empty_table()
        q, out = shared.value, []
        entry = codes.column("entry").to_numpy()
        order = np.argsort(entry)
        entry = entry[order]
        code = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(entry), -1)[order]
        number, block = codes.column("list")[0].as_py(), codes.column("block")[0].as_py()
        for part in wanted.to_batches(max_chunksize=256):
            near = q.inner_products(unit(_matrix(part.column("v"))).astype(np.float32), number, code)
            best = np.argsort(-near, axis=1, kind="stable")[:, : q.keep]
            ends = pa.array(np.arange(part.num_rows + 1) * best.shape[1], pa.int32())
            values = pa.array(np.take_along_axis(near, best, 1).ravel(), pa.float32())
            out.append(pa.table([part.column("query"), pa.array(np.full(part.num_rows, number * most + block)), pa.ListArray.from_arrays(ends, pa.array(entry[best.ravel()])), pa.ListArray.from_arrays(ends, values)], schema=schema))
        return pa.concat_tables(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = shared.value.keep
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for row in range(batch.num_rows):
                entries = batch.column("entries")[row].values.flatten().to_numpy()
                nears = batch.column("nears")[row].values.flatten().to_numpy()
                best = np.lexsort((entries, -nears))[:keep]
                out[0].append(entries[best])
                out[1].append(nears[best])
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("slot"), pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.float32()))], ["query", "slot", "entries", "nears"])

    near = placed.groupBy("list", "block").cogroup(probes.groupBy("list", "block")).applyInArrow(search, "query long, slot long, entries array<long>, nears array<float>")
    slots = len(model.centroids) * most
    while True:  # slots: list and block, then groups of them
        slots = -(-slots // s.fan)
        gathered = near.groupBy("query", F.expr(f"slot div {s.fan}").alias("slot")).agg(F.collect_list("entries").alias("entries"), F.collect_list("nears").alias("nears"))
        near = gathered.mapInArrow(merge, "query long, slot long, entries array<long>, nears array<float>")
        if slots == 1:
            break
    best = near.select("query", F.explode("entries").alias("entry"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = cosine(_matrix(batch.column("qv")), _matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("ids"), pa.array(found)], ["query", "ids", "score"])

    vectors_of = single.select("query", F.col("v").alias("qv"))
    pairs = best.join(entries, "entry").join(vectors_of, "query").select("query", "qv", "v", "ids")
    scored = pairs.mapInArrow(score, "query long, ids array<long>, score double")
    scored = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    # One more than k, as one of them can be the query itself.
    top = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query", "score", "vec_id")
    same = asked.join(single.select("query", "key", "v"), ["key", "v"]).select("query", F.col("id").alias("query_id")).distinct()
    answers = same.join(top, "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
