"""Substring dedup by fixed-block anchors: repeated runs of words go, all but the first.

Every document is cut into reference blocks of BLOCK words that don't overlap, and the
index keeps, for each block's hash, the smallest and largest row with it. Rolling windows of
BLOCK words probe the index. A repeat of LENGTH words covers RUNS whole reference blocks one
after another, whose probes lie BLOCK words apart; so it is enough to probe the rolling
windows that begin in every RUNS-th stretch of BLOCK positions: one of the RUNS probes is
always among them. Around a hit the others are probed, too, and only RUNS hits in a row
extend to the LENGTH-word windows around them; the windows' own 128-bit hashes then tell
exactly which of them begin in a smaller document, and consecutive ones join to maximal
repeats. Of rows with the same words only one is extended.

What is looked up is stored first, so that joins read two plain shuffles, of which Spark
splits a side where one block or window is very common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch
from plumbline.llm.wordhash import BASES, Words, ranges, slices, split_words

LENGTH = 50
BLOCK = 10
RUNS = (LENGTH - BLOCK + 1) // BLOCK
#: Rows without an id count as those of the largest id.
NO_ID = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").digest()


def sequences(words: Words, key: int) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    return ranges(words.hashes, BASES[key], words.first[:-1], words.first[1:]).view(np.int64)


def _keys(part: pa.RecordBatch) -> np.ndarray:
    return part.column("key").to_numpy()


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text")
            words = split_words(texts)
            kept = [hashlib.sha256(b" ".join((t or "").encode().split())).digest() for t in texts.to_pylist()]
            yield _batch(key=part.column("key"), id=part.column("id"), n_words=words.counts, seq=sequences(words, 1), seq2=sequences(words, 2), kept=kept)


def _reference_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"))
            grams, at = words.grams(BLOCK)
            text = words.text_of(at)
            own = (at - words.first[text]) % BLOCK == 0
            yield _batch(block=grams[own].view(np.int64), key=_keys(part)[text[own]])


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"))
            grams, at = words.grams(BLOCK)
            text = words.text_of(at)
            place = at - words.first[text]
            own = place // BLOCK % RUNS == 0
            yield _batch(block=grams[own].view(np.int64), key=_keys(part)[text[own]], place=place[own].astype(np.int32))


def _marks(words: Words, part: pa.RecordBatch, column: str) -> np.ndarray:
    """Whether each word of a slice is one of the places in a column."""
    sizes = pc.list_value_length(part.column(column)).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(part.num_rows), sizes)
    out = np.zeros(len(words.hashes) + RUNS * BLOCK, bool)
    out[np.asarray(part.column(column).flatten()).astype(np.int64) + words.first[text]] = True
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The probes up to RUNS - 1 blocks from a hit that weren't made yet."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"))
            hit = _marks(words, part, "hits")
            grams, at = words.grams(BLOCK)
            text = words.text_of(at)
            where = np.flatnonzero(hit[: len(words.hashes)])
            owner = words.text_of(where)
            wanted = np.zeros(len(words.hashes), bool)
            for step in range(-BLOCK * (RUNS - 1), BLOCK * RUNS, BLOCK):
                to = where + step
                wanted[to[(to >= words.first[owner]) & (to < words.first[owner + 1])]] = True
            own = wanted[at] & ~hit[at]
            yield _batch(block=grams[own].view(np.int64), key=_keys(part)[text[own]], place=(at - words.first[text])[own].astype(np.int32))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The LENGTH-word windows that hold RUNS hits in a row."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"))
            first, at = words.grams(LENGTH, 1)
            second, _ = words.grams(LENGTH, 2)
            if not len(at):
                continue
            n = len(words.hashes)
            hit = _marks(words, part, "hits") | _marks(words, part, "more")
            run = hit[:n].copy()
            for k in range(1, RUNS):
                run &= hit[k * BLOCK : n + k * BLOCK]
            where = np.flatnonzero(run)
            change = np.zeros(n + 1, np.int64)  # windows from LENGTH - RUNS * BLOCK before a run to its beginning
            np.add.at(change, np.maximum(where - (LENGTH - RUNS * BLOCK), words.first[words.text_of(where)]), 1)
            np.add.at(change, where + 1, -1)
            own = np.cumsum(change)[at] > 0
            at, text = at[own], words.text_of(at[own])
            yield _batch(w1=first[own].view(np.int64), w2=second[own].view(np.int64), key=_keys(part)[text], id=part.column("id").take(pa.array(text)), place=(at - words.first[text]).astype(np.int32))


def covered(places: np.ndarray, n_words: int) -> np.ndarray:
    """Which words lie in a window that begins at one of places."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, np.minimum(places + LENGTH, n_words), -1)
    return np.cumsum(change)[:-1] > 0


def _cut(part: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, str]]:
    """key, n_removed, digest of the kept words, and the text without the removed ones."""
    texts = part.column("text")
    words = split_words(texts)
    keys, data = _keys(part), words.data.tobytes()
    offsets = np.append(0, np.cumsum(pc.binary_length(texts.cast(pa.large_binary())).fill_null(0).to_numpy()))
    for i, found in enumerate(part.column("found").to_pylist()):
        a, b = words.first[i], words.first[i + 1]
        gone = covered(np.array(found, np.int64), b - a)
        start, end = words.start[a:b], words.end[a:b]
        kept = b" ".join(data[s:e] for s, e in zip(start[~gone].tolist(), end[~gone].tolist(), strict=True))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        text, at = [], offsets[i]
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            text.append(data[at : start[s]])
            at = end[e - 1]
        text.append(data[at : offsets[i + 1]])
        yield int(keys[i]), int(gone.sum()), hashlib.sha256(kept).digest(), b"".join(text).decode()


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            keys, removed, kept, texts = zip(*_cut(part), strict=True)
            yield _batch(key=keys, n_removed=removed, rest=kept, cut_text=texts)


@dataclass(frozen=True)
class Deduplicated:
    """What went from each row of a table."""

    keyed: DataFrame  #: key (of a row), id and row, a struct
    described: DataFrame  #: key, id, n_words, kept (digest), first (smallest id with the same words) and its key
    cuts: DataFrame  #: key, n_removed, rest (digest) and cut_text of rows of which some words went
    text_col: str

    def _told(self) -> DataFrame:
        """described with copy (gone as a whole), n_removed, rest and cut_text."""
        rows = self.described.withColumn("copy", F.expr(f"id > first AND n_words >= {LENGTH}"))
        # Copies look up nothing; their own keys spread them.
        rows = rows.withColumn("asked", F.expr("CASE WHEN id = first THEN first_key ELSE -1 - key END"))
        return rows.join(self.cuts.withColumnRenamed("key", "asked"), "asked", "left").drop("asked")

    def verdicts(self) -> DataFrame:
        """doc_id, n_words, n_removed and kept_sha256 of every row."""
        kept = F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.coalesce("rest", "kept"))
        return self._told().select(
            F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words",
            F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.lower(F.hex(kept)).alias("kept_sha256"),
        )

    def texts(self) -> DataFrame:
        """The rows with the repeats cut out of their texts; a row of which nothing is left goes.

        Needs dedup(whole=True). Rows with one id and the same words get one text.
        """
        told = self._told().where("copy OR n_removed > 0").select("key", F.expr("copy OR n_removed = n_words").alias("gone"), "cut_text")
        rows = self.keyed.join(told, "key", "left").where("NOT coalesce(gone, false)")
        text = F.when(F.col("gone").isNotNull(), F.col("cut_text")).otherwise(F.col("row").getField(self.text_col))
        return rows.select(*(text.alias(n) if n == self.text_col else F.col("row").getField(n).alias(n) for n in self.keyed.schema["row"].dataType.names))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> Deduplicated:
    """Removes each word in a window of LENGTH words that also begins in a smaller document.

    Words are runs of other characters than the six ASCII separators. Windows are judged on
    the input. Null and empty text has no words; very long texts are one row like others; a
    null id counts as the largest; rows with one id don't remove from each other, equal or
    not; an empty table gives an empty one. A row whose whole word sequence is that of a
    smaller document is removed as a whole. Of equal windows in several smaller documents any
    counts. Every row is a node of its own, whatever its id. Other columns, whatever their
    names, are read only with whole=True, and pass through texts().
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if whole else [text_col])))
    keyed = scratch.store(docs.select(F.monotonically_increasing_id().alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), row.alias("row")), "keyed")
    rows = keyed.select("key", "id", F.col("row").getField(text_col).alias("text"))
    base = scratch.store(rows.mapInArrow(_described, "key long, id long, n_words long, seq long, seq2 long, kept binary"), "base")
    firsts = scratch.store(base.groupBy("seq", "seq2").agg(F.min(F.struct("id", "key")).alias("f")).select("seq", "seq2", F.col("f.id").alias("first"), F.col("f.key").alias("first_key")), "firsts")
    described = scratch.store(base.join(firsts, ["seq", "seq2"]).drop("seq", "seq2"), "described")
    scratch.drop("base", "firsts")

    other = "low <> key OR high <> key"
    index = scratch.store(rows.mapInArrow(_reference_blocks, "block long, key long").groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high")), "index")
    probes = rows.mapInArrow(_probes, "block long, key long, place int")
    hits = scratch.store(probes.join(index, "block").where(other).groupBy("key").agg(F.collect_list("place").alias("hits")), "hits")
    wanted = described.where(f"key = first_key AND n_words >= {LENGTH}").select("key")
    # Texts are dealt by key alike at every size, and not sorted.
    marked = scratch.store(rows.join(hits.join(wanted, "key").hint("shuffle_hash"), "key"), "marked")
    again = marked.mapInArrow(_neighbours, "block long, key long, place int").join(index, "block").where(other)
    more = scratch.store(again.groupBy("key").agg(F.collect_list("place").alias("more")), "more")
    scratch.drop("index", "hits")
    runs = scratch.store(marked.join(more.hint("shuffle_hash"), "key"), "runs")
    scratch.drop("marked", "more")
    # Hashing them again costs less than keeping them.
    windows = runs.mapInArrow(_windows, "w1 long, w2 long, key long, id long, place int")
    least = scratch.store(windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("w1", "w2", "low"), "least")
    found = windows.join(least, ["w1", "w2"]).where("id > low").groupBy("key").agg(F.collect_list("place").alias("found"))
    cuts = runs.select("key", "text").join(found.hint("shuffle_hash"), "key").mapInArrow(_cuts, "key long, n_removed long, rest binary, cut_text string")
    cuts = scratch.store(cuts.where("n_removed > 0"), "cuts")
    scratch.drop("runs", "least")
    return Deduplicated(keyed, described, cuts, text_col)
