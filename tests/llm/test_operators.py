"""Every operator against a brute-force version, over awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import license_scan, mixing, near_dedup, nearest, packing, quality_classifier, quality_rules, sharding, substring_dedup, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns named like the operators' own, to show that they don't get in the way.
CLASHES = ("id", "n", "key", "block", "shard", "part", "tokens", "kept", "score", "component", "rank", "size")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{rng.choice(['', '', ',', '.'])}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, short, empty, null, blank and long texts."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(30, 260)) for _ in range(40)]
    passage = prose(rng, 70)
    near = []
    for t in base[:12]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    shared = [f"{prose(rng, 60)}\n{passage} {prose(rng, 40)}" for _ in range(8)]
    notice = [f"{prose(rng, 50)} Licensed under the Apache License, Version 2.0. {prose(rng, 50)}", "Released under the MIT License."]
    lines = ["same line here\nsame line here\nother\n\n \nsame line here", "a b c d e f g h " * 9]
    odd = [None, "", " \t\n", "one", "Two Words", "é ü 日本語 　 x", "x " * 3000, prose(rng, 6000, 50)]
    return [*base, *near, *base[:10], *shared, *notice, *lines, *odd, *odd[:3]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "fr", None)[i % 3], "hot" if i % 3 else f"s{i % 5}", *("z" for _ in CLASHES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def nameless(spark, text):
    """Two rows without id and a repeated row."""
    rows = [(None, text, None, None), (None, text, "en", "s"), (7, text, "en", "s"), (7, text, "en", "s")]
    return spark.createDataFrame([(*r, *(None for _ in CLASHES)) for r in rows], SCHEMA)


def test_token_counts(spark, docs, texts, empty):
    tokenizer = Tokenizer.from_file(PATH)
    want = {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    got = by_id(token_counts.token_counts(docs, PATH), "n_bytes", "n_tokens", "over_limit")
    assert got == {i: (b, n, n > 512) for i, (b, n) in want.items()}
    assert token_counts.token_counts(empty, PATH).count() == 0 and token_counts.token_counts(nameless(spark, "a b"), PATH).count() == 4


def check_pieces(rows, ids_of, window=1024):
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for parts in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(parts))) and min(parts)[0] == 0 and sum(n for _, n in parts) <= window
    for doc, parts in pieces.items():
        ids, at = ids_of(doc), 0
        for start, n, crc, total in sorted(parts):
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    return pieces, sequences


def test_packing(spark, docs, texts, empty):
    tokenizer = Tokenizer.from_file(PATH)
    ids_of = lambda i: [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0]
    for shard_docs in (512, 16):
        pieces, sequences = check_pieces(packing.pack(docs, PATH, shard_docs=shard_docs).collect(), ids_of)
        assert set(pieces) == set(range(len(texts)))
        assert len(sequences) * 1024 - sum(n for p in sequences.values() for _, n in p) < 1024 * math.ceil(len(texts) / shard_docs) * 2
    assert packing.pack(empty, PATH).count() == 0
    assert packing.pack(nameless(spark, "a b"), PATH).agg(F.sum("length")).first()[0] == 12


def test_packing_follows_scores():
    rng = np.random.default_rng(0)
    kinds = [np.arange(k * 100, k * 100 + 60) for k in range(4)]
    tails = [rng.choice(kinds[i % 4], 40).astype("<u4") for i in range(40)]
    alike = [len({d % 4 for d, _, _ in s}) for s in packing.fill(tails, 160)]
    assert sum(a == 1 for a in alike) > len(alike) / 2


def shared(rows, pairs):
    """The share of pairs of documents that have a sequence in common."""
    of = {}
    for r in rows:
        of.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    return sum(bool(of[a] & of[b]) for a, b in pairs) / len(pairs)


def test_packing_brings_copies_together(spark):
    """Equal and near texts share sequences, though shards are many and ids say nothing."""
    rng = random.Random(8)
    texts = [prose(rng, 60, 3000) for _ in range(300)]
    near = [t.replace(t.split()[30], f"w{rng.randrange(3000)}", 1) for t in texts]
    rows = [(i, t) for i, t in enumerate([*texts, *texts, *near])]
    rows[0] = (0, texts[0] + " " + prose(rng, 2000, 3000))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, window=1024, shard_docs=32, part_docs=200).collect()
    assert len({r["sequence_id"] >> packing.PART_BITS for r in got}) >= 3 and {r["doc_id"] for r in got} == set(range(900))
    assert shared(got, [(i, 300 + i) for i in range(300)]) >= 0.9 and shared(got, [(i, 600 + i) for i in range(300)]) >= 0.8


def test_packing_deals_out_hot_rows(spark):
    """One text and one id, or none, many times: dealt among the parts, each row with its pieces."""
    rows = [(None if i % 2 else 7, "a b c d") for i in range(900)] + [(1000 + i, f"e{i} f g h") for i in range(300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, window=64, shard_docs=50, part_docs=100).collect()
    assert sum(r["length"] for r in got if r["doc_id"] is None or r["doc_id"] == 7) == 900 * 5
    parts = {}
    for r in got:
        if r["start"] == 0:
            parts[r["sequence_id"] >> packing.PART_BITS] = parts.get(r["sequence_id"] >> packing.PART_BITS, 0) + 1
    assert len(parts) >= 6 and max(parts.values()) <= 400


def brute_bm25(bags, seed):
    """Scores of all bags (id to count) for one of them."""
    n, mean = len(bags), sum(sum(b.values()) for b in bags) / len(bags)
    df = {}
    for b in bags:
        for t in b:
            df[t] = df.get(t, 0) + 1
    out = []
    for b in bags:
        score = 0.0
        for t, asked in bags[seed].items():
            if t in b:
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                norm = packing.K1 * (1 - packing.B + packing.B * sum(b.values()) / mean)
                score += idf * b[t] * (packing.K1 + 1) / (b[t] + norm) * (packing.K3 + 1) * asked / (packing.K3 + asked)
        out.append(score)
    return out


def test_packing_against_brute_force():
    """Scores and the whole greedy filling, document by document; ties go to the first."""
    rng = np.random.default_rng(1)
    tails = [rng.zipf(1.3, rng.integers(5, 60)).clip(1, 400).astype("<u4") for _ in range(80)]
    tails[7] = tails[3].copy()
    bags = [dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True)), strict=True)) for t in tails]
    index = packing.Index([tuple(np.unique(t, return_counts=True)) for t in tails])
    for i in range(80):
        assert index.scores(i) == pytest.approx(brute_bm25(bags, i))
    left, want, now, room, seed = list(range(80)), [], [], 100, None
    while left:
        if seed is None:
            seed = doc = left[0]
        else:
            scores = brute_bm25(bags, seed)
            doc = min(left, key=lambda d: (-round(scores[d], 9), d))
        left.remove(doc)
        at, size = 0, len(tails[doc])
        if size > room:
            want.append([*now, (doc, 0, room)])
            at, now, room, seed = room, [], 100, doc
        now.append((doc, at, size))
        room -= size - at
        if not room:
            want.append(now)
            now, room, seed = [], 100, None
    assert packing.fill(tails, 100) == want + ([now] if now else [])


def test_packing_index_holds_whole_texts():
    """A long document is found by its beginning, which its tail doesn't show."""
    ids = [np.arange(0, 50), np.arange(100, 150), np.arange(200, 250)]
    tails = [ids[0].astype("<u4"), ids[1].astype("<u4"), ids[2].astype("<u4")]
    bags = [(t, np.ones(len(t), np.int64)) for t in (ids[0], ids[1], np.concatenate([ids[2], ids[0]]))]
    assert [[d for d, _, _ in s] for s in packing.fill(tails, 100, bags)] == [[0, 2], [1]]


def test_near_dedup(spark, docs, texts, empty):
    for n in (4, 5):
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        words = [WORD.findall((t or "").translate(lower)) for t in texts]
        sets = [set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in words]
        parent = list(range(len(texts)))

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in itertools.combinations(range(len(texts)), 2):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        want = {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}
        assert by_id(near_dedup.near_duplicates(docs, shingle=n), "n_shingles", "component_id", "kept") == want
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = near_dedup.near_duplicates(nameless(spark, "a b c d e f")).collect()
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None] and all(r["kept"] for r in rows)


def test_near_dedup_compares_split_buckets(spark):
    """A chain of copies, each further from the first: heads alone can't link all of it."""
    rng = random.Random(5)
    words = [f"v{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words)))
        for _ in range(8):
            words[rng.randrange(400)] = f"v{rng.randrange(10**6)}"
    rng.shuffle(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(396)} for i, t in rows}
    reach = {0}
    while more := {i for i in sets if i not in reach and any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in reach)}:
        reach |= more
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("component_id = 0")
    assert {r["doc_id"] for r in got.collect()} == reach


def brute_substrings(rows, n=50):
    """By (id, text) rows sorted by id: words and which of them go."""
    first, out = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((w, gone))
    return out


def test_substring_dedup(spark, docs, texts, empty):
    want = {}
    for i, (w, gone) in enumerate(brute_substrings(list(enumerate(texts)))):
        rest = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(rest.encode()).hexdigest())
    done = substring_dedup.dedup(docs, whole=True)
    assert done.texts().columns == docs.columns
    assert by_id(done.verdicts(), "n_words", "n_removed", "kept_sha256") == want
    cut = {r["doc_id"]: r["text"] for r in done.texts().collect()}
    for i, (n, removed, digest) in want.items():
        if removed and removed == n:
            assert i not in cut
        elif removed:
            assert hashlib.sha256(" ".join(WORD.findall(cut[i])).encode()).hexdigest() == digest
        else:
            assert cut[i] == texts[i]
    assert substring_dedup.dedup(empty).verdicts().count() == 0
    rows = substring_dedup.dedup(nameless(spark, " ".join(f"k{i}" for i in range(60)))).verdicts().collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in rows) == [(7, 0), (7, 0), (99, 60), (99, 60)]


def test_sharding(spark, docs, texts, empty):
    rows = sharding.assign(docs).collect()
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "key") and r["grown_shard"] in (r["shard"], 40)
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.assign(empty).count() == 0
    assert len({r["slot"] for r in sharding.assign(nameless(spark, "a")).where("doc_id = 7").collect()}) == 2


def test_sharding_counts_equal_rows(spark, monkeypatch):
    """Many equal rows, and many of one id, have a slot each."""
    monkeypatch.setattr(sharding, "COPIES", 64)
    docs = spark.createDataFrame([(None if i % 2 else 5, "t" * (i % 3)) for i in range(1000)] + [(i, "u") for i in range(50)], "doc_id long, text string")
    rows = sharding.assign(docs, shards=3).collect()
    assert len(rows) == 1050
    for shard in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_sharding_weights_confine_movement(spark):
    rows = spark.range(20_000).withColumn("k", F.col("id").cast("string"))
    old = sharding.tree(40)
    new = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 0 else 1.0) for x in old]
    moved = sharding.descend(sharding.descend(rows, old, F.col("k"), "a"), new, F.col("k"), "b")
    pairs = moved.groupBy("a", "b").count().collect()
    region = {x.shard: x.region for x in old}
    assert all(region[p["b"]] == "r0" for p in pairs if p["a"] != p["b"])
    share = {s: sum(p["count"] for p in pairs if p["b"] == s) / 20_000 for s in range(40)}
    assert share[0] == pytest.approx(3 / 42, abs=0.01) and share[20] == pytest.approx(1 / 42, abs=0.006)


def test_quality_rules(spark, docs, texts, empty):
    limits = quality_rules.Limits(classes=0.12, words=0.3, min_chars=50, min_words=20)
    known = {i: (int(i % 4 != 1), int(i % 10 == 0)) for i in range(0, len(texts), 2)}
    labels = spark.createDataFrame([(i, *k) for i, k in known.items()] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels, limits).collect()}
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    tests = [lambda c: "a" <= c <= "z", lambda c: ord(c) > 127, lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in " \t\n\x0b\x0c\r"]
    held = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        counts = [sum(map(f, t or "")) for f in tests]
        counts = [*counts[:4], len(t or "") - sum(counts), counts[4]]
        common = quality_rules.COMMON_WORDS.get(langs[i])
        named = [sum(x.lower() == c for x in w) for c in common] if common else None
        held[i] = (w, counts, named and [*named, len(w) - sum(named)])
    total = {}
    for i, (_, c, n) in held.items():
        if known.get(i) == (1, 0):
            a, b = total.setdefault(langs[i], (np.zeros(6), np.zeros(41)))
            a += c
            b += n or 0

    def distance(p, q):
        p, q = np.array(p, float), np.array([0.0] if q is None else q, float)
        if not p.sum() or not q.sum():
            return None
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        part = lambda a: (a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum() / 2
        return math.sqrt(max(0, part(p) + part(q)))

    for i, (w, counts, named) in held.items():
        t, r = texts[i] or "", got[i]
        spots = {}
        for k in range(len(w) - 7):
            spots.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeats = {p for s in spots.values() if len(s) > 1 for k in s for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(repeats) > 30 * len(w)
        classes, commons = total.get(langs[i], (None, None))
        dc = distance(counts, classes) if len("".join(w)) >= 50 else None
        dw = distance(named, commons) if named and len(w) >= 20 else None
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == (len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeats), failed)
        assert (r["class_distance"], r["word_distance"]) == (pytest.approx(dc) if dc is not None else None, pytest.approx(dw) if dw is not None else None)
        assert r["kept"] == (not failed and (dc or 0) <= 0.12 and (dw or 0) <= 0.3)
    assert total and quality_rules.judge(empty, labels).count() == 0 and quality_rules.judge(nameless(spark, "a b"), labels).count() == 4
    # What isn't trusted moves no verdict.
    junk = docs.withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.lit("### $$$ " * 400))
    more = by_id(quality_rules.judge(docs.unionByName(junk), labels, limits), "kept", "class_distance", "word_distance")
    assert {i: more[i][0] for i in got} == {i: r["kept"] for i, r in got.items()}


def test_quality_rules_know_languages(spark):
    """Prose of common words is kept, and the same words in another language's place aren't."""
    rng = random.Random(2)
    rows = []
    for i in range(120):
        lang, other = ("en", "de") if i % 2 else ("de", "en")
        common = quality_rules.COMMON_WORDS[other if i >= 100 else lang]
        rows.append((i, " ".join(rng.choice(common) if rng.random() < 0.4 else f"{prose(rng, 1)}" for _ in range(200)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(quality_rules.judge(docs, spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")), "kept")
    assert all(got[i][0] for i in range(100)) and not any(got[i][0] for i in range(100, 120))


def bisected(own, entropy, repeats):
    """The exponent by plain bisection."""
    total = sum(own.values())

    def weights(a):
        power = {s: (n / total) ** a for s, n in own.items()}
        return {s: p / sum(power.values()) for s, p in power.items()}

    def flat(a):
        return -sum(w * math.log(w) for w in weights(a).values()) >= entropy * math.log(len(own))

    def often(a):
        return max(w * total / own[s] for s, w in weights(a).items()) > repeats

    out = []
    for holds in (flat, often):
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        out.append(1.0 if holds(1.0) else 0.0 if not holds(0.0) else (low if holds is flat else high))
    return max(out)


@pytest.mark.parametrize(("entropy", "repeats"), [(0.5, 100.0), (0.99, 100.0), (0.5, 1.3), (1.0, 4.0), (0.9, 1.0)])
def test_mixing_temperature(spark, entropy, repeats):
    own = {f"s{i}": 3 ** i for i in range(9)}
    sources = spark.createDataFrame(list(own.items()), "source string, tokens long")
    got = mixing.temperature(sources, mixing.Mix(entropy=entropy, repeats=repeats))
    assert got == pytest.approx(bisected(own, entropy, repeats), abs=1e-9)


def test_mixing_orders_many_blocks_in_parts(spark, monkeypatch):
    """A permutation that is cut into parts is the same permutation."""
    docs = spark.createDataFrame([(i, "x" * 37, "a" if i % 5 else "b") for i in range(900)], "doc_id long, text string, source string")
    mix = mixing.Mix(entropy=0.9, block_tokens=20)
    rows = lambda: sorted(map(tuple, mixing.draw(docs, mix).collect()))
    whole = rows()
    monkeypatch.setattr(mixing, "PART_BLOCKS", 16)
    assert rows() == whole


def test_mixing(spark, empty):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400), "big" if i % 3 else f"s{i % 12}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(entropy=0.97, repeats=2.0, block_tokens=512)
    tokens = {i: (len(t) + 3) // 4 for i, t, _ in rows}
    own = {}
    for i, _, s in rows:
        own[s] = own.get(s, 0) + tokens[i]
    alpha = mixing.temperature(mixing.source_tokens(docs, "source", mixing.estimated_tokens(F.col("text"))), mix)
    total = sum(own.values())
    weight = {s: (n / total) ** alpha for s, n in own.items()}
    weight = {s: w / sum(weight.values()) for s, w in weight.items()}
    entropy = -sum(w * math.log(w) for w in weight.values()) / math.log(len(own))
    repeats = max(w * total / own[s] for s, w in weight.items())
    assert 0 < alpha < 1 and repeats <= 2.0 + 1e-6 and (entropy == pytest.approx(0.97, abs=1e-6) or repeats == pytest.approx(2.0, abs=1e-6))
    drawn = mixing.draw(docs, mix).collect()
    for s, n in own.items():
        rows_of = sorted((r for r in drawn if r["source"] == s), key=lambda r: r["start"])
        budget, at = math.floor(weight[s] * total + 1e-9), 0
        for r in rows_of:
            assert (r["start"], r["tokens"], r["epoch"]) == (at, tokens[r["doc_id"]], at // n if at % n or not at else r["epoch"])
            at += r["tokens"]
        assert budget <= at < budget + 101
        for e in range(budget // n):
            assert sum(tokens[r["doc_id"]] for r in rows_of if r["epoch"] == e) == n
    whole = mixing.draw(docs, mix, whole=True).select("row.*")
    assert whole.columns == docs.columns and whole.count() == len(drawn)
    assert alpha == pytest.approx(bisected(own, 0.97, 2.0), abs=1e-12)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x" * 200_000, None), (4, "y" * 40, "b"), (None, "z" * 40, "b")], "doc_id long, text string, source string")
    got = mixing.draw(odd, mixing.Mix(block_tokens=16)).collect()
    assert {r["doc_id"] for r in got} == {3, 4, None} and {r["tokens"] for r in got if r["doc_id"] == 3} == {50_000}
    assert mixing.draw(empty).count() == 0 and mixing.draw(nameless(spark, "abcd")).where("doc_id = 7").count() >= 2


def test_license_scan(spark, docs, texts, empty):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    plain = lambda t: [x.lower() for x in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    want = set()
    for i, t in enumerate(texts):
        g = grams(plain(t))
        for name, template in license_scan.TEMPLATES.items():
            s = set(grams(plain(template)))
            c = 1 << (len(s) - 1).bit_length()
            best = max((len(s & set(g[a : a + 2 * c])) for a in range(0, len(g), c)), default=0)
            if best >= math.ceil(0.8 * len(s) - 1e-9):
                want.add((i, name, best / len(s)))
    got = {(r["doc_id"], r["license"], r["containment"]) for r in license_scan.scan(docs).collect()}
    assert got == want and {"Apache-2.0", "MIT"} <= {n for _, n, _ in got}
    assert all((1 - n / (2 * c + len(s) - n)) ** scanner.bands[c] <= 1e-6 for c, own in scanner.classes.items() for i in own for n, s in [(scanner.need[i], scanner.sets[i])])
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(nameless(spark, "Released under the MIT License.")).count() == 4


def test_license_scan_covers_families(spark):
    gpl = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
    gpl += """ This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    isc += license_scan.TEXTS["ISC-text"].partition("copies.")[2]
    samples = [gpl, isc, "see https://creativecommons.org/licenses/by-sa/4.0/ for more", *license_scan.TEXTS.values()]
    want = ["GPL-notice", "ISC-text", "CC-BY-SA-4.0-url", *license_scan.TEXTS]
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, f"{prose(rng, 40)} {t} {prose(rng, 40)}") for i, t in enumerate(samples)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(docs).collect()}
    assert set(enumerate(want)) <= got
    # No other version or family.
    assert {n for i, n in got if i == 0} == {"GPL-notice", "GNU-3-or-later"} and {n for i, n in got if i == 2} == {"CC-BY-SA-4.0-url"}
    assert {"BSD-2-Clause-text", "BSD-3-Clause-text", "GPL-2.0-text", "LGPL-2.1-text", "MPL-2.0-text", "Unlicense-text", "EPL-1.0-text"} <= set(want)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[300:900] = x[5]  # one very common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0]), (2004, [None] + [1.0] * 23), (None, [1.0] * 24), (3, rows[3][1])]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, key string")
    got = {}
    for r in nearest.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 20):
        score = u @ u[q]
        score[q] = -9
        order = np.lexsort((np.arange(1500), -score.round(12)))[:5]
        hits += len({int(v) for v in order} & {v for v, _ in got[q]})
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        assert all(s == pytest.approx(u[q] @ u[v], abs=1e-12) for v, s in got[q])
    assert set(got) == set(range(0, 1500, 20)) and hits >= 0.9 * 5 * 75
    assert [v for v, _ in got[300]] == [5, 301, 302, 303, 304]
    assert nearest.nearest(table.where("false"), table).count() == 0
    two = table.where("vec_id IN (0, 1)")
    assert sorted((r["query_id"], r["vec_id"]) for r in nearest.nearest(two, two).collect()) == [(0, 1), (1, 0)]


@pytest.mark.parametrize("factor", [1.0, 1e-200, 1e200])
def test_nearest_of_extreme_vectors(spark, factor):
    """Tiny and huge components neither vanish nor overflow."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    table = spark.createDataFrame([(i, (v * (factor if i % 2 else 1.0)).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in nearest.nearest(table, table.where("vec_id < 4")).collect():
        order = [v for v in np.argsort(-(u @ u[r["query_id"]]), kind="stable") if v != r["query_id"]]
        assert (r["vec_id"], r["score"]) == (order[r["rank"] - 1], pytest.approx(u[r["query_id"]] @ u[r["vec_id"]], abs=1e-12))


def test_nearest_of_many_lists(spark):
    """An inverted file with many lists, in several blocks, merged in several rounds."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    settings = nearest.Settings(per_list=150, block=64, fan=8, keep=60)
    model = nearest.train(x[:4000].astype(float), 6000, 5, settings)
    assert len(model.centroids) == 40 and 1 <= model.probes < 30 and model.keep >= 60
    got = {}
    for r in nearest.nearest(table, table.where("vec_id % 50 = 0"), settings=settings).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        score = u @ u[q]
        score[q] = -9
        hits += len(got[q] & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 0.9 * 5 * 120


def test_quality_classifier_held_out(spark):
    """Half of the labels are fitted on; the other half is told apart."""
    rng = random.Random(4)
    good = [prose(rng, rng.randint(20, 80), 60) for _ in range(300)]
    bad = [" ".join(w + "***" for w in prose(rng, rng.randint(20, 80), 60).split()) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)], "doc_id long, quality int, toxic int")
    fitted = quality_classifier.resample(docs, labels)
    got = by_id(fitted.verdicts(), "kept")
    assert sum(got[i][0] for i in range(1, 300, 2)) >= 147 and sum(got[i][0] for i in range(301, 360, 2)) <= 2
    kept = fitted.filter(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (k,) in got.items() if k}
    scores = sorted(r["key"] for r in fitted.keys.collect())
    for k in (1, 7, 180, 360):
        assert quality_classifier.kth_largest(fitted.keys, k) == scores[-k]


def test_quality_classifier_rejects_toxic(spark):
    """Long toxic documents of good quality are told from clean ones, with half of the labels held out."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        w = prose(rng, 300, 60).split()
        if i % 6 == 0:
            w[rng.randrange(300)] = rng.choice(["idiot", "trash"])
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600) if i % 4 < 2], "doc_id long, quality int, toxic int")
    got = by_id(quality_classifier.resample(docs, labels).verdicts(), "kept")
    assert not any(got[i][0] for i in range(0, 600, 6)) and sum(k for k, in got.values()) >= 495


def test_quality_classifier_against_brute_force(spark, docs, texts):
    """Counts, ratios, toxic evidence, scores, keys and the kept rows by dictionaries."""
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, f"{prose(rng, 40, 90)} {'vile' if i % 3 == 0 else 'mild'}! {prose(rng, 20, 90)}") for i in range(200, 500)]
    rows += [(499, rows[-1][1])] * 3
    known = {i: (int(i % 5 != 1), int(i >= 200 and i % 3 == 0)) for i, _ in rows if i % 4 != 2}
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, *k) for i, k in known.items()], "doc_id long, quality int, toxic int")
    token = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\u0080-\U0010ffff\x20\x09-\x0D]+")
    hashes = {}

    def grams(text):
        """The hash of each word and pair; that of a word alone is a whole text's first."""
        w = [x.lower() if x.isascii() else x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in token.findall(text or "")]
        return [(x,) for x in w] + list(itertools.pairwise(w))

    def hash_of(gram):
        if gram not in hashes:
            found, _ = quality_classifier.features(pa.array([" ".join(gram)]))
            hashes[gram] = int(found[-1])
        return hashes[gram]

    n, held = quality_classifier.BUCKETS, [(i, [hash_of(g) for g in grams(t)]) for i, t in rows]
    good = {i for i, (q, x) in known.items() if q and not x}
    raw, target, with_gram, toxic_gram = ({} for _ in range(4))
    for i, h in held:
        for x in h:
            raw[x % n] = raw.get(x % n, 0) + 1
            target[x % n] = target.get(x % n, 0) + (i in good)
        if i in known:
            for x in {x % quality_classifier.EVIDENCE for x in h}:
                with_gram[x] = with_gram.get(x, 0) + 1
                toxic_gram[x] = toxic_gram.get(x, 0) + known[i][1]
    usual = sum(known[i][1] for i, _ in held if i in known) / sum(i in known for i, _ in held)
    bad = set()
    for x, c in with_gram.items():
        share = toxic_gram[x] / c
        apart = c * (share * math.log(share / usual) + ((1 - share) * math.log((1 - share) / (1 - usual)) if share < 1 else 0)) if share else 0
        if share >= max(quality_classifier.TOXIC_SHARE, usual) and apart >= math.log(len(with_gram) / quality_classifier.CHANCE):
            bad.add(x)
    tn, rn = sum(target.values()), sum(raw.values())
    ratio = {b: math.log((target[b] + 1) / (tn + n)) - math.log((c + 1) / (rn + n)) for b, c in raw.items()}
    want = []
    for i, h in held:
        noise = quality_classifier.gumbel(pa.array([i], pa.int64()), 0)[0]
        score = sum(ratio[x % n] for x in h)
        toxic = any(x % quality_classifier.EVIDENCE in bad for x in h)
        want.append((i, score, score + noise - (quality_classifier.PENALTY if toxic else 0)))
    assert bad and any(k < -1e8 for _, _, k in want)
    fitted = quality_classifier.resample(own, labels)
    got = sorted((r["doc_id"], r["score"], r["key"]) for r in fitted.keys.collect())
    assert len(got) == len(want) and all(a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-6) for a, b in zip(got, sorted(want), strict=True))
    k = round(sum(i in good for i in known) / len(known) * len(rows))
    least = sorted((x for _, _, x in want), reverse=True)[k - 1]
    kept = sorted(i for i, _, x in want if x >= least - 1e-6)
    assert sorted(r["doc_id"] for r in fitted.verdicts().where("kept").collect()) == kept
    # Ties at the last key: all of them stay.
    tied = quality_classifier.resample(own.where("doc_id = 499"), labels, share=0.5)
    assert [r["kept"] for r in tied.verdicts().collect()] == [True] * 4


def test_quality_classifier_edges(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality_classifier.resample(docs, labels).verdicts().collect())
    assert quality_classifier.resample(empty, labels).filter(empty).count() == 0
    some = spark.createDataFrame([(7, 1, None), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.resample(nameless(spark, None), some).verdicts().count() == 4
