"""Importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Lower-cased word and sign runs and their pairs are hashed into a fixed number of buckets.
The target model counts the n-grams of labelled good documents, the raw model those of all
documents. A document's score is the sum of log(target / raw) over its n-grams; the kept
documents are those with the largest score plus Gumbel noise, which is a sample without
replacement by importance weight.

An n-gram is evidence of toxic text if so many of the labelled documents that hold it are
toxic that chance would hardly give one such n-gram. One is enough, whatever the length: a
document that holds any is kept only where too few others are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, small_batches
from plumbline.llm.wordhash import U64, mix, slices, split_words

BUCKETS = 1 << 16
#: Buckets of the evidence of toxic text.
EVIDENCE = 1 << 22
#: Least share of toxic ones among the labelled documents that hold an n-gram of evidence, and
#: how likely chance may give one such n-gram.
TOXIC_SHARE, CHANCE = 0.8, 0.05
#: What evidence takes off a key: more than any score.
PENALTY = 1e9
#: At most so many labelled rows are used, those with the smallest hash of their id.
LABELLED_ROWS = 100_000
#: Buckets of one round of the search for the k-th largest key.
ROUND = 4096


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a slice of texts, and the number of their text."""
    words = split_words(texts, lower=True, signs=True)
    pairs, at = words.grams(2)
    return np.concatenate([words.hashes, pairs]), words.text_of(np.concatenate([np.arange(len(words.hashes)), at]))


def bucketed(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return (hashes & U64(buckets - 1)).astype(np.int64)


def evidence(rows: DataFrame) -> np.ndarray:
    """The buckets that tell toxic text, sorted; rows: text, toxic of labelled documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bad = np.zeros(EVIDENCE, np.int32), np.zeros(EVIDENCE, np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, text = features(part.column("text"))
                pairs = np.unique(text * EVIDENCE + bucketed(hashes, EVIDENCE))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
                for counts, own in ((held, pairs), (bad, pairs[toxic[pairs // EVIDENCE]])):
                    bucket, n = np.unique(own % EVIDENCE, return_counts=True)
                    counts[bucket] += n.astype(np.int32)
        some = np.flatnonzero(held)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some].astype(np.int64)), pa.array(bad[some].astype(np.int64))], ["bucket", "held", "bad"])

    usual = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not usual or usual == 1:
        return np.zeros(0, np.int64)
    counts = rows.mapInArrow(count, "bucket long, held long, bad long").groupBy("bucket").agg(F.sum("held").alias("held"), F.sum("bad").alias("bad"))
    counts = Scratch(rows.sparkSession, "evidence").store(counts, "counts")
    tested = counts.count()
    # Chernoff's bound of the chance that so many of those that hold an n-gram are toxic.
    share = F.col("bad") / F.col("held")
    apart = F.col("held") * (share * F.log(share / usual) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - usual))).otherwise(0.0))
    found = counts.where((share >= max(TOXIC_SHARE, usual)) & (apart >= float(np.log(tested / CHANCE)))).select("bucket").toPandas()
    return np.sort(found["bucket"].to_numpy(np.int64))


def gumbel(ids: pa.Array, seed: int) -> np.ndarray:
    """Noise that depends on the id and the seed alone; null counts as -1."""
    x = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
    u = (mix(mix(x) ^ mix(np.array([seed], U64))) >> U64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


@dataclass(frozen=True)
class Model:
    """log(target / raw) by bucket, the share of documents to keep, the noise's seed, and the buckets that tell toxic text."""

    ratio: np.ndarray
    share: float
    seed: int

    toxic: np.ndarray

    @cached_property
    def _tells(self) -> np.ndarray:
        """Whether each bucket tells toxic text; made where it is used, not sent."""
        out = np.zeros(EVIDENCE, bool)
        out[self.toxic] = True
        return out

    def judged(self, texts: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores and keys."""
        hashes, text = features(texts)
        score = np.bincount(text, self.ratio[bucketed(hashes)], len(texts)).astype(float)
        toxic = np.bincount(text[self._tells[bucketed(hashes, EVIDENCE)]], minlength=len(texts)) > 0
        return score, score + gumbel(ids, self.seed) - PENALTY * toxic


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS) -> Model:
    """The models of docs' texts. labels: doc_id, quality (1: good), toxic (1: no target).

    Raw counts are those of all documents; the target's are those of at most labelled_rows
    labelled rows, and the share to keep is that of targets (good and not toxic) among these.
    Without a target every ratio is 0 and the share is 1.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("id"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"),
        ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("target"),
    )
    sample = known.orderBy(F.xxhash64("id"), "id", "toxic", "target").limit(labelled_rows).groupBy("id").agg(F.max("target").alias("target"), F.max("toxic").alias("toxic"))
    share = sample.agg(F.avg(F.col("target").cast("double"))).first()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, text = features(part.column("text"))
                bucket = bucketed(hashes)
                raw += np.bincount(bucket, minlength=BUCKETS)
                wanted = part.column("target").to_numpy(zero_copy_only=False).astype(bool)
                target += np.bincount(bucket[wanted[text]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    wanted = sample.where("target").select("id", F.lit(True).alias("target"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The sample's bound makes it safe to broadcast, so that texts aren't shuffled.
    toxic = evidence(rows.join(F.broadcast(sample.select("id", "toxic")), "id").select("text", "toxic"))
    rows = rows.join(F.broadcast(wanted), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not share or not target.sum():
        return Model(np.zeros(BUCKETS), 1.0, seed, toxic)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return Model(ratio, float(share), seed, toxic)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of column key, by counting in ever narrower ranges."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = (high - low) / ROUND
        bucket = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(ROUND - 1)).cast("int")
        found = keys.where(F.col("key").between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(found.collect(), key=lambda r: -r["b"]):
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    return low


@dataclass(frozen=True)
class Fitted:
    """A model with the key that a document needs to be kept over one corpus."""

    model: Model
    threshold: float
    keys: DataFrame  #: doc_id, score and key of every row

    def filter(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The kept rows of docs, with all their columns; texts aren't shuffled."""
        shared = docs.sparkSession.sparkContext.broadcast(self.model)
        threshold = self.threshold

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                for part in slices(batch, text_col):
                    _, key = model.judged(part.column(text_col), part.column(id_col))
                    yield part.filter(pa.array(key >= threshold))

        return docs.mapInArrow(keep, docs.schema)

    def verdicts(self) -> DataFrame:
        """doc_id, score and kept of every row."""
        return self.keys.select("doc_id", "score", (F.col("key") >= F.lit(self.threshold)).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """Keeps the round(share * rows) documents with the largest noisy score.

    share: by default that of good, not toxic rows among the labels. Null and empty text score 0; a
    null id has the noise of id -1; repeated rows share their key, so that they are kept or
    rejected together (and ties at the k-th key are all kept); an empty table keeps
    nothing; other columns, whatever their names, pass through filter().
    """
    spark = docs.sparkSession
    model = fit(docs, labels, seed, id_col, text_col)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s, key = shared.value.judged(part.column("text"), part.column("doc_id"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array(key)], ["doc_id", "score", "key"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = Scratch(spark, "resample").store(rows.mapInArrow(score, "doc_id long, score double, key double"), "keys")
    k = round((model.share if share is None else share) * keys.count())
    threshold = float("inf") if k < 1 else kth_largest(keys, k)
    return Fitted(model, threshold, keys)
