"""Lexical retrieval packing: fixed-length training sequences of lexically close documents.

Documents are ordered lexically, by min-hashes of their token ids that prefer rare ones: a
range partition of that order, sorted, is cut into index shards of shard_docs documents, so
that copies and documents that share rare ids mostly lie in one. Each shard holds a BM25
inverted index over all token ids of its documents, with the document frequencies of the
whole input. A seed's nearest unused neighbours fill its window with what is left of them
after whole windows were cut from their beginning, in order of score; the one that crosses
the window's end is cut there, and its rest is the next seed. So only a shard's last sequence
is padded. Neighbours in other shards aren't found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import Memo
from plumbline.llm.common import Scratch
from plumbline.llm.wordhash import U64, mix, slices

K1, B = 1.2, 0.75
#: How far an id counts more that occurs several times in the seed.
K3 = 8.0
TOKENIZED = "doc_id long, doc_tokens long, crcs array<long>, tail binary, n_terms int, terms binary, counts binary"
TOKENIZED_NAMES = [f.split()[0] for f in TOKENIZED.split(", ")]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences of one part of the order have ids from part * 2 ** 40.
PART_BITS = 40
#: Parts of the order at most, and documents of the sample, for each part, that the parts'
#: bounds are taken from. A part is sorted with spilling, so it may be large.
MOST_PARTS, SAMPLED = 1 << 14, 64
#: Bits of the order for each level.
LEVEL_BITS = 21
#: Levels of the lexical order: ids in a smaller share of the documents aren't preferred, as
#: few documents could meet in them.
LEVELS = (0.05, 0.02, 0.02)

_encoders: dict[str, Memo] = {}


def encoder(path: str) -> Memo:
    """Ids of texts, by the tokenizers library.

    Units that begin with a space and end with none are encoded many at once, as one string
    that the pre-tokenizer cuts between them in any case; the tokens' bytes tell whose they are.
    """
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        n_bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            n_bytes[i] = len(token)  # a sign stands for a byte

        def separate(parts: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

        def alone(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = separate(parts)
            return np.concatenate([*found, np.zeros(0, np.uint32)]), np.array([len(x) for x in found], np.int64)

        def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            joint = np.array([p[:1] == " " and not p[-1].isspace() for p in parts], bool)
            rest, rest_sizes = alone([p for p, j in zip(parts, joint.tolist(), strict=True) if not j])
            sizes = np.zeros(len(parts), np.int64)
            sizes[~joint] = rest_sizes
            some = [p for p, j in zip(parts, joint.tolist(), strict=True) if j]
            if not some:
                return rest, sizes
            (ids,) = separate(["".join(some)])
            ends = np.cumsum(n_bytes[ids])
            last = np.cumsum([len(p.encode()) for p in some])
            at = np.searchsorted(ends, last)
            if at.max() >= len(ends) or (ends[at] != last).any():
                raise ValueError(f"{path} doesn't cut texts before a space")
            sizes[joint] = np.diff(at, prepend=-1)
            flat, owner = np.empty(sizes.sum(), np.uint32), np.repeat(joint, sizes)
            flat[owner], flat[~owner] = ids, rest
            return flat, sizes

        _encoders[path] = Memo(encode, np.uint32, [t.content for t in tokenizer.get_added_tokens_decoder().values()], whole_of=alone)
    return _encoders[path]


def narrow(x: np.ndarray) -> str:
    """The narrower of two types that holds x."""
    return "<u2" if x.max(initial=0) < 1 << 16 else "<u4"


def wide(raw: bytes, n: int) -> np.ndarray:
    """n numbers that narrow() chose the type of."""
    return np.frombuffer(raw, f"<u{len(raw) // n}" if n else "<u4")


def tokenized(docs: DataFrame, vocabulary: str, window: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc_tokens, crcs (of its whole windows), tail (the ids after them), n_terms, terms and counts.

    The last id of a document is the separator 0. A document that fills whole windows
    exactly has an empty tail. terms are the distinct ids of the whole text, without the
    separator, and counts how often each occurs. Arrays are bytes of narrow() numbers.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, step = encoder(vocabulary), 4 * window
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, crcs, tails = [], [], []
                values, first = memo.gather(part.column("text"))
                raw, bounds = values.astype("<u4").tobytes(), (4 * first).tolist()
                # Short keys sort faster.
                bits, kind = (16, np.uint32) if part.num_rows < 1 << 16 and (not len(values) or values.max() < 1 << 16) else (32, np.int64)
                keys, tf = np.unique(np.repeat(np.arange(part.num_rows, dtype=kind) << bits, np.diff(first)) | values.astype(kind), return_counts=True)
                begin = np.searchsorted(keys, np.arange(part.num_rows, dtype=kind) << bits).tolist() + [len(keys)]
                terms, as_id = keys & ((1 << bits) - 1), narrow(values)
                width, as_tf = np.dtype(as_id).itemsize, narrow(tf)
                ids2, terms, tf = values.astype(as_id).tobytes(), terms.astype(as_id).tobytes(), tf.astype(as_tf).tobytes()
                for a, b in pairwise(bounds):
                    n = (b - a) // 4 + 1
                    whole = n // window * window
                    sizes.append(n)
                    ends = raw[a:b] + b"\0\0\0\0" if whole == n else raw[a : a + 4 * whole]
                    crcs.append([zlib.crc32(ends[at : at + step]) for at in range(0, 4 * whole, step)])
                    tails.append(ids2[(a // 4 + whole) * width : b // 4 * width] + b"\0" * width if whole < n else b"")
                spans = list(pairwise(begin))
                cut = lambda x, w, spans=spans: pa.array([x[a * w : b * w] for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary()), pa.array(np.diff(begin).astype(np.int32)), cut(terms, width), cut(tf, np.dtype(as_tf).itemsize)],
                    TOKENIZED_NAMES,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, TOKENIZED)


def bags_of(batch: pa.RecordBatch | pa.Table, column: str = "terms") -> list[np.ndarray]:
    return [wide(t, n) for t, n in zip(batch.column(column).to_pylist(), batch.column("n_terms").to_pylist(), strict=True)]


@dataclass(frozen=True)
class Frequencies:
    """How many documents there are, and by id how many of them hold it."""

    n: int
    df: np.ndarray

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))


def frequencies(rows: DataFrame) -> Frequencies:
    """Of all documents of tokenized()."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.concatenate([*bags_of(batch), np.zeros(0, "<u2")]), minlength=len(total))
            found[: len(total)] += total
            total = found
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    found = rows.select("n_terms", "terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(int(found["term"].max()) + 1 if len(found) else 1, np.int64)
    df[found["term"]] = found["n"]
    return Frequencies(rows.count(), df)


def preferences(known: Frequencies) -> list[np.ndarray]:
    """For each level, the place of each id in a random order that favours rare ones."""
    out = []
    for level, least in enumerate(LEVELS):
        u = ((mix(mix(np.arange(len(known.df)).astype(U64)) ^ mix(np.array([level], U64))) >> U64(11)).astype(float) + 0.5) / 2.0**53
        weight = known.idf() * np.where(known.df > least * known.n, 1, 1e-9)
        place = np.empty(len(u), np.int64)
        place[np.argsort(-np.log(u) / weight, kind="stable")] = np.arange(len(u))
        out.append(place)
    return out


def lexical_order(bags: list[np.ndarray], preferred: list[np.ndarray]) -> np.ndarray:
    """Numbers that order documents: LEVEL_BITS bits of the preferred id of each level.

    Documents with equal sets of ids, as copies, have one number.
    """
    sizes = np.array([len(b) for b in bags], np.int64)
    some = np.flatnonzero(sizes)
    out = np.zeros(len(bags), np.int64)
    terms, first = np.concatenate([*bags, np.zeros(0, "<u2")]).astype(np.int64), (np.cumsum(sizes) - sizes)[some]
    for place in preferred:
        cell = np.zeros(len(bags), np.int64)
        if len(some):
            best = np.minimum.reduceat(place[terms], first)
            cell[some] = best if len(place) <= 1 << LEVEL_BITS else (mix(best.astype(U64)) >> U64(64 - LEVEL_BITS)).astype(np.int64)
        out = out << LEVEL_BITS | cell
    return out


class Index:
    """BM25 over token ids; postings of a term are a run of doc, weight.

    bags: the distinct ids of each document and how often each occurs. known: document
    frequencies, by default those of the bags.
    """

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], known: Frequencies | None = None):
        n = len(bags)
        docs = np.repeat(np.arange(n), [len(t) for t, _ in bags])
        terms, tf = (np.concatenate([b[k] for b in bags]).astype(np.int64) for k in (0, 1))
        sizes = np.bincount(docs, tf, n)
        # 16 bits sort by radix.
        order = np.argsort(terms.astype(np.uint16) if terms.max(initial=0) < 1 << 16 else terms, kind="stable")
        self.docs, tf = docs[order], tf[order]
        self.terms, first, df = np.unique(terms[order], return_index=True, return_counts=True)
        self.first, self.last = first, first + df
        idf = known.idf()[self.terms] if known else Frequencies(n, df).idf()
        norm = K1 * (1 - B + B * sizes / max(sizes.mean(), 1))
        self.weights = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.docs])
        term_at = np.empty(len(order), np.int64)
        term_at[order] = np.repeat(np.arange(len(self.terms)), df)
        ends = np.cumsum(np.bincount(self.docs, minlength=n))[:-1]
        self.terms_of = np.split(term_at, ends)
        told = np.concatenate([b[1] for b in bags]).astype(float)
        self.asked = np.split((K3 + 1) * told / (K3 + told), ends)
        self.n = n

    def scores(self, doc: int) -> np.ndarray:
        """Of all documents, for the terms of one of them."""
        query = self.terms_of[doc]
        size = self.last[query] - self.first[query]
        skip = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.first[query] - skip, size)
        return np.bincount(self.docs[at], self.weights[at] * np.repeat(self.asked[doc], size), self.n)


def fill(tails: list[np.ndarray], window: int, bags: list[tuple[np.ndarray, np.ndarray]] | None = None, known: Frequencies | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, from, to) pieces that hold each tail's ids once.

    bags and known: as in Index; by default the ids of the tails alone.
    """
    some = [i for i, t in enumerate(tails) if len(t)]
    if not some:
        return []
    index = Index([bags[i] if bags else np.unique(tails[i], return_counts=True) for i in some], known)
    sizes = [len(tails[i]) for i in some]
    used, out, now, room = np.zeros(len(some), bool), [], [], window
    seed, left, scores = 0, len(some), None
    while left:
        if scores is None:  # a window begins, and no cut document is its seed
            while used[seed]:
                seed += 1
            doc = seed
        else:
            scores[used] = -1.0
            doc = int(scores.argmax())
        used[doc] = True
        left -= 1
        at, size = 0, sizes[doc]
        if size > room:
            now.append((some[doc], 0, room))
            out.append(now)
            at, now, room, scores = room, [], window, None
        now.append((some[doc], at, size))
        room -= size - at
        if not room:
            out.append(now)
            now, room, scores = [], window, None
        elif scores is None:  # doc begins this window: it is the seed
            scores = index.scores(doc)
    return out + [now] if now else out


def packed(shard: pa.Table, window: int, first_sequence: int, known: Frequencies) -> tuple[pa.RecordBatch, int]:
    """The pieces of one index shard, and the number of its sequences."""
    ids, sizes, crcs = (shard.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs"))
    tails = [wide(t, n % window) for t, n in zip(shard.column("tail").to_pylist(), sizes, strict=True)]
    found, sequence = [], first_sequence
    for i, own in enumerate(crcs):
        for k, crc in enumerate(own):
            found.append((ids[i], k * window, window, crc, sizes[i], sequence, 0))
            sequence += 1
    for pieces in fill(tails, window, list(zip(bags_of(shard), bags_of(shard, "counts"), strict=True)), known):
        offset = 0
        for i, a, b in pieces:
            found.append((ids[i], len(crcs[i]) * window + a, b - a, zlib.crc32(tails[i][a:b].astype("<u4").tobytes()), sizes[i], sequence, offset))
            offset += b - a
        sequence += 1
    names = [f.split()[0] for f in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names), sequence - first_sequence


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, shard_docs: int = 512, part_docs: int = 1 << 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of at most window ids.

    doc_id, start (the document's ids before the piece), length, ids_crc32, doc_tokens (with
    the separator), sequence_id and offset (in the sequence). Every id of every row lies in
    one piece; null and empty text is the separator alone; a very long text gives whole
    windows and one tail; a null id stays null; rows with one id, or equal rows, are packed
    each for itself, and however many there are, no task holds them all; an empty table gives
    no pieces; other columns are not read. Of equal scores the document that comes first in
    the order is taken. A task holds shard_docs documents at a time, whatever the input's size;
    a part of the order has about part_docs, or more where there would be over MOST_PARTS.
    """
    spark = docs.sparkSession
    rows = Scratch(spark, "pack").store(tokenized(docs, vocabulary, window, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "tokenized")
    known = frequencies(rows)
    # Rows with one id, and copies, are told apart by where they were read.
    rows = rows.withColumn("salt", F.xxhash64("row")).drop("row")
    preferred = spark.sparkContext.broadcast(preferences(known))
    parts = min(MOST_PARTS, max(1, -(-known.n // part_docs)))

    def order(batch: pa.RecordBatch) -> np.ndarray:
        return lexical_order(bags_of(batch), preferred.value)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(order(batch))], ["place"])

    # A sample of about SAMPLED rows a part cuts the order into parts of like size; every row is dealt.
    sample = rows.where(F.pmod("salt", F.lit(max(1, known.n // (SAMPLED * parts)))) == 0) if parts > 1 else rows.where("false")
    places = np.sort(sample.select("n_terms", "terms").mapInArrow(ordered, "place long").toPandas()["place"].to_numpy(np.int64))
    bounds = spark.sparkContext.broadcast(places[np.arange(1, parts) * len(places) // parts] if len(places) else places)
    held = spark.sparkContext.broadcast(known)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = order(batch)
            low, high = (np.searchsorted(bounds.value, place, side=s) for s in ("left", "right"))
            # A place that is the bound of several parts is dealt among them.
            own = low + (batch.column("salt").to_numpy().view(U64) % (high - low + 1).astype(U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(place)], [*batch.schema.names, "part", "place"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, part, sequences = [], None, 0

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, sequences
            table = pa.Table.from_batches(waiting).combine_chunks() if waiting else None
            while table is not None and table.num_rows >= least:
                done, n = packed(table.slice(0, shard_docs), window, (part << PART_BITS) + sequences, held.value)
                yield done
                sequences += n
                table = table.slice(shard_docs) if table.num_rows > shard_docs else None
            waiting = table.to_batches() if table is not None else []

        for batch in batches:
            own = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), batch.num_rows]
            for a, b in pairwise(cuts):
                if a == b:
                    continue
                if own[a] != part:
                    yield from ready(1)
                    part, sequences = int(own[a]), 0
                waiting.append(batch.slice(a, b - a))
                if sum(w.num_rows for w in waiting) >= shard_docs:
                    yield from ready(shard_docs)
        yield from ready(1)

    dealt = rows.mapInArrow(deal, f"{TOKENIZED}, salt long, part long, place long")
    return dealt.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "place", "salt").mapInArrow(pieces, PIECES)
