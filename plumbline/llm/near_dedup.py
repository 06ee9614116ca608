"""MinHash near-dedup with tensored banding.

Two collections of M half keys, each of T minhashes, give M * M table keys: every pair of
a half key of the first and one of the second collection. So 2 * M * T minhashes do the
work of 2 * M * M * T, and two documents of similarity s meet in a table with probability
(1 - (1 - s^T)^M)^2: 0.9996 at 0.8, 0.99999 at 0.85.

Documents with one shingle set are one node. In each table bucket the members are compared
with the bucket's head alone, on full shingle sets, and the links give components.
Buckets whose members lie in several components are not cut off: their members are grouped
by the rarest shingles of each (a prefix that two sets of the wanted similarity must
share), and the groups' components are compared with each other, block by block, where their
sets' sizes allow a link.

What is looked up is stored first, so that joins read two plain shuffles, of which Spark
splits a side where one key is very common; texts meet in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch
from plumbline.llm.components import components
from plumbline.llm.wordhash import BASES, U64, first_of_runs, mix, ranges, slices, split_words

M, T = 12, 3
#: Counters of the shingle frequencies that order a prefix; any order is right.
COUNTERS = 1 << 16
#: Texts of a block, and shingles that a task compares at once.
BLOCK, COLUMNS = 128, 2048
#: Nodes whose table rows one task makes.
NODES = 1 << 13
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 32, 2 * M * T, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, 2 * M * T, dtype=np.uint32) | np.uint32(1)


@dataclass
class Sets:
    """The shingle sets of a slice of texts, each sorted; first: where each set begins."""

    shingles: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.sizes)

    def key(self, k: int) -> np.ndarray:
        return ranges(self.shingles, BASES[k], self.first[:-1], self.first[1:]).view(np.int64)


def shingle_sets(texts: pa.Array, n: int) -> Sets:
    """Sets of hashes of n words, A-Z lower-cased; a shorter text's words are one shingle."""
    words = split_words(texts, lower=True)
    grams, at = words.grams(n)
    text = words.text_of(at)
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    whole = ranges(words.hashes, BASES[1], words.first[short], words.first[short + 1])
    grams, text = np.concatenate([grams, whole]), np.concatenate([text, short])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = first_of_runs(grams) | first_of_runs(text)
    return Sets(grams[new], np.searchsorted(text[new], np.arange(len(texts) + 1)))


def sliced_sets(texts: pa.Array, n: int) -> Sets:
    """The same for many texts, a slice at a time."""
    parts = [shingle_sets(part.column("text"), n) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
    sizes = np.concatenate([p.sizes for p in parts])
    return Sets(np.concatenate([p.shingles for p in parts]), np.append(0, np.cumsum(sizes)))


def half_keys(sets: Sets) -> np.ndarray:
    """For each set, its 2 * M half keys; 0 for an empty set."""
    out = np.zeros((len(sets.first) - 1, 2 * M), U64)
    some = np.flatnonzero(sets.sizes)
    if not len(some):
        return out.view(np.int64)
    x, start = (sets.shingles >> U64(32)).astype(np.uint32), sets.first[some]
    for half in range(2 * M):
        key = np.full(len(some), half + 1, U64)
        for k in range(half * T, half * T + T):
            key = mix(key ^ np.minimum.reduceat((x ^ _XOR[k]) * _ODD[k], start).astype(U64))
        out[some, half] = key
    return out.view(np.int64)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), n)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(half_keys(sets).ravel()), 2 * M).cast(pa.list_(pa.int64()))
                yield _batch(id=part.column("id"), n=sets.sizes, k1=sets.key(1), k2=sets.key(2), halves=keys)

    return run


def _linked(n: int, percent: int):
    """Links of a head (side 0) and the members that are compared with it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = sliced_sets(table.column("text").combine_chunks(), n)
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        head = int(np.flatnonzero(side == 0)[0])
        own = sets.shingles[sets.first[head] : sets.first[head + 1]]
        at = np.minimum(np.searchsorted(own, sets.shingles), max(len(own) - 1, 0))
        common = np.bincount(sets.owner[own[at] == sets.shingles], minlength=len(ids))
        linked = (side == 1) & (100 * common >= percent * (sets.sizes + len(own) - common))
        return pa.table({"a": pa.array(np.full(linked.sum(), ids[head])), "b": pa.array(ids[linked])})

    return run


def _prefixes(n: int, percent: int, counts):
    """The rarest shingles of each text, as many as two similar sets can't both do without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), n)
                often = counts.value[(sets.shingles & U64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((sets.shingles, often, sets.owner))
                place = np.arange(len(order)) - sets.first[sets.owner]
                size = sets.sizes[sets.owner]
                own = place < size + (-percent * size) // 100 + 1  # size - ceil(share * size) + 1
                text = sets.owner[own]
                columns = {c: part.column(c).take(pa.array(text)) for c in ("id", "component")}
                yield _batch(token=sets.shingles[order][own].view(np.int64), n=sets.sizes[text], **columns)

    return run


def _counted(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount((shingle_sets(part.column("text"), n).shingles & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        if len(some):
            yield _batch(counter=some, n=total[some])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (head, node) that are links. A head meets about BLOCK of its members at a time."""
    sizes = scratch.store(pairs.groupBy("head").agg(F.count("*").alias("n")), "heads")
    placed = pairs.join(sizes, "head").select("head", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("part"), "node")
    members = placed.withColumnRenamed("node", "id").withColumn("side", F.lit(1))
    heads = placed.select("head", "part").distinct().select("head", "part", F.col("head").alias("id"), F.lit(0).alias("side"))
    met = members.select("head", "part", "id", "side").unionByName(heads).join(texts, "id")
    return met.groupBy("head", "part").applyInArrow(_linked(n, percent), "a long, b long")


def _links_across(n: int, percent: int):
    """Links between different components of one pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = sliced_sets(table.column("text").combine_chunks(), n)
        component, side = table.column("component").to_numpy(), table.column("side").to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: both
        _, token, often = np.unique(sets.shingles, return_inverse=True, return_counts=True)
        owner, shared = sets.owner, often > 1
        renumbered = np.cumsum(shared) - 1
        own = shared[token]
        column, owner = renumbered[token[own]], owner[own]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [at, at + COLUMNS])
            held = np.zeros((table.num_rows, COLUMNS), np.float32)
            held[owner[a:b], column[a:b] - at] = 1
            common += held[left] @ held[right].T
        size = sets.sizes.astype(np.float32)
        union = size[left][:, None] + size[right][None, :] - common
        linked = (100 * common >= percent * union) & (union > 0) & (component[left][:, None] != component[right][None, :])
        i, j = np.nonzero(linked)
        ids = table.column("id").to_numpy()
        return pa.table({"a": pa.array(ids[left[i]]), "b": pa.array(ids[right[j]])})

    return run


def _across(texts: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links between components of one group; texts: id, n, component, group, text.

    A group is cut by the sizes of sets, so that links lie within a size class or between
    two neighbours, and then into blocks of about BLOCK texts: a large component has blocks of
    its own, smaller ones share blocks. Every two blocks that can hold a link meet in a task
    of their own, but those of one component; only links come out.
    """
    texts = texts.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int"))
    group = ["group", "class"]
    sizes = texts.groupBy(*group, "component").agg(F.count("*").alias("size"))
    small = sizes.groupBy(*group).agg(F.sum(F.when(F.col("size") < BLOCK, F.col("size")).otherwise(0)).alias("small"))
    sizes = sizes.join(small, group)
    large = F.col("size") >= BLOCK
    sizes = scratch.store(sizes.select(*group, "component", F.when(large, F.col("component")).alias("pure"), F.ceil(F.when(large, F.col("size")).otherwise(F.col("small")) / BLOCK).alias("parts")), "sizes")
    part = F.when(F.col("pure").isNotNull(), F.pmod(F.xxhash64("id"), "parts")).otherwise(F.pmod(F.xxhash64("component"), "parts"))
    placed = texts.join(sizes, [*group, "component"]).withColumn("block", F.xxhash64(*group, "pure", part))
    placed = scratch.store(placed.select("id", "component", "text", "group", "class", "block", "pure"), "placed")
    blocks = scratch.store(placed.groupBy("group", "class", "block", "pure").agg(F.min("component").alias("low"), F.max("component").alias("high")), "blocks")
    # A block meets those of its class from itself on, and all of the next class.
    other = blocks.select("group", F.explode(F.array("class", F.col("class") - 1)).alias("class"), F.col("class").alias("own"), F.col("block").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    meets = blocks.join(other, group).where("(own > class OR block <= other) AND NOT (low = high AND other_low = other_high AND low = other_low)")
    meets = meets.select(F.xxhash64("block", "other").alias("meeting"), "block", "other")
    sides = meets.select("meeting", "block", F.when(F.col("block") == F.col("other"), 2).otherwise(0).alias("side"))
    sides = sides.unionByName(meets.where("block <> other").select("meeting", F.col("other").alias("block"), F.lit(1).alias("side")))
    met = placed.join(sides, "block").select("meeting", "side", "component", "id", "text")
    return met.groupBy("meeting").applyInArrow(_links_across(n, percent), "a long, b long")


def groups(rows: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """id, n (size of the shingle set) and component of rows (id, text; ids unique, a stored table).

    component is the smallest id reachable; null for an empty set. Equal sets are one node, so
    that of any number of copies one takes part in what follows.
    """
    signed = scratch.store(rows.mapInArrow(_signed(shingle), "id long, n long, k1 long, k2 long, halves array<long>"), "signed")
    full = signed.where("n > 0")
    nodes = scratch.store(full.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("halves").alias("halves")), "nodes")
    known = scratch.store(full.select("id", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "node"), "known")

    # One row for each node and table.
    tables = F.expr(f"flatten(transform(slice(halves, 1, {M}), x -> transform(slice(halves, {M + 1}, {M}), y -> xxhash64(x, y))))")
    spread = nodes.select("node", "halves").repartition(max(1, nodes.count() // NODES))
    keys = spread.select("node", F.explode(tables).alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = scratch.store(keys.join(sizes, "key").select("key", "node", "n"), "shared")
    # The head of a bucket is its node with the most company over all tables: of a text and
    # its many altered copies, most likely the text that they were made from.
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    heads = scratch.store(shared.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("head")), "bucket_heads")
    members = scratch.store(shared.join(heads, "key").where("node <> head").select("key", "head", "node"), "members")
    scratch.drop("shared", "bucket_heads")
    pairs = scratch.store(members.select("head", "node").distinct(), "pairs")
    paired = pairs.select(F.col("head").alias("id")).unionByName(pairs.select(F.col("node").alias("id"))).distinct()
    # Texts are dealt by id alike at every size, and not sorted.
    texts = scratch.store(rows.join(paired.hint("shuffle_hash"), "id"), "texts")
    links = scratch.store(_verified(pairs, texts, shingle, percent, scratch), "links")
    found = scratch.store(components(links, scratch, "first"), "found")

    # Buckets that hold several components: no pair between these has been left out so far
    # but those with neither at the head.
    of_head = found.select(F.col("id").alias("head"), F.col("component").alias("head_component"))
    of_node = found.select(F.col("id").alias("node"), F.col("component").alias("node_component"))
    placed = members.join(of_head, "head", "left").join(of_node, "node", "left")
    placed = placed.select("key", "head", "node", F.coalesce("head_component", "head").alias("hc"), F.coalesce("node_component", "node").alias("nc"))
    split = scratch.store(placed.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("hc") != F.col("nc")).alias("apart")).where("apart AND n > 1").select("key"), "split")
    some = placed.join(split, "key")
    some = some.select(F.col("head").alias("id"), F.col("hc").alias("component")).unionByName(some.select(F.col("node").alias("id"), F.col("nc").alias("component"))).distinct()
    open_texts = scratch.store(texts.join(some, "id"), "open")
    counts = open_texts.select("text").mapInArrow(_counted(shingle), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(COUNTERS, np.int64)
    often[counts["counter"]] = counts["n"]
    schema = "token long, n long, id long, component long"
    postings = open_texts.mapInArrow(_prefixes(shingle, percent, rows.sparkSession.sparkContext.broadcast(often)), schema)
    postings = scratch.store(postings, "postings")
    tokens = scratch.store(postings.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("a")).where("low < high").select("token", "a"), "tokens")
    near = scratch.store(components(postings.join(tokens, "token").select("a", F.col("id").alias("b")), scratch, "groups").withColumnRenamed("component", "group"), "near")
    sized = postings.select("id", "n").distinct()
    more = scratch.store(_across(open_texts.join(near, "id").join(sized, "id"), shingle, percent, scratch).distinct(), "more")
    scratch.drop("postings", "open", "texts", "members", "pairs")
    found = scratch.store(components(links.unionByName(more), scratch, "last"), "ends").withColumnRenamed("id", "node")
    ends = known.join(found, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    return scratch.store(signed.select("id", "n").join(ends, "id", "left"), "grouped")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked if 100 * intersection >= percent * union of their sets of shingle
    words (lower-cased A-Z). component_id is the smallest id reachable; kept tells whether
    it is the row's own. A text without words, or null, has an empty set and is alone; so
    is a row with a null id, whose component is null and which is kept. Rows with one id
    are one document, with all their texts; each row has its result. Ties can't arise: a
    component has one smallest id. Very long texts are compared as a whole; an empty table
    gives an empty one; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near")
    keyed = scratch.store(docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text")), "keyed")
    sets = scratch.store(groups(keyed.where("own IS NOT NULL").select(F.col("key").alias("id"), "text"), shingle, percent, scratch).join(keyed.where("own IS NOT NULL").select(F.col("key").alias("id"), "own"), "id"), "sets")
    # Rows with one id bring their components together.
    several = scratch.store(sets.where("component IS NOT NULL").groupBy("own").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("own", "low"), "several")
    bridges = sets.where("component IS NOT NULL").join(several, "own").where("component <> low").select(F.col("low").alias("a"), F.col("component").alias("b")).distinct()
    top = scratch.store(components(bridges, scratch, "bridges").withColumnRenamed("component", "top").withColumnRenamed("id", "component"), "top")
    rows = scratch.store(sets.join(top, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top"), "rows")
    least = scratch.store(rows.where("component IS NOT NULL").groupBy("component").agg(F.min("own").alias("component_id")), "least")
    # A row without words belongs to the component of its id's other rows, if there are any.
    empty = rows.where("component IS NULL").select("id", "own", "n")
    of_id = rows.where("component IS NOT NULL").join(empty.select("own").distinct(), "own", "left_semi").groupBy("own").agg(F.min("component").alias("component"))
    rows = rows.where("component IS NOT NULL").select("own", "n", "component").unionByName(empty.join(of_id, "own", "left").select("own", "n", "component"))
    out = rows.join(least, "component", "left").select("own", "n", F.coalesce("component_id", "own").alias("component_id"))
    nameless = keyed.where("own IS NULL").select(F.col("key").alias("id"), "text").mapInArrow(_signed(shingle), "id long, n long, k1 long, k2 long, halves array<long>")
    out = out.unionByName(nameless.select(F.lit(None).cast("long").alias("own"), "n", F.lit(None).cast("long").alias("component_id")))
    return out.select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("own") == F.col("component_id"), F.lit(True)).alias("kept"))
