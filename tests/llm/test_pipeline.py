"""The pipeline's stages, each on its predecessor's output."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    base = [prose(rng.randint(60, 200)) for _ in range(60)]
    passage = prose(60)
    texts = [*base, *base[:6], *(f"{prose(30)} {passage} {prose(30)}" for _ in range(5)), *(" ".join(w + "%%%" for w in prose(50).split()) for _ in range(12)), None, "", "short"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("%%%" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.dtypes == columns
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not any("%%%" in (r["text"] or "") for r in seen["quality_classifier"].values())
    assert not set(range(60, 66)) & set(seen["near_dedup"]) and set(range(60)) <= set(seen["near_dedup"]) | set(range(60)) - set(seen["quality_classifier"])
    assert sum(passage in (r["text"] or "") for r in seen["substring_dedup"].values()) == 1
    assert all(r["n_chars"] == len(r["text"] or "") for r in seen["substring_dedup"].values() if r["text"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.count() > 0 and {r["doc_id"] for r in packed.collect()} == set(seen["packing"])


CLASHES = ("key", "row", "id", "own", "component", "kept", "__kept", "__id", "__changes", "gone", "cut_text", "tokens", "block")


def test_stages_of_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, null and very long texts, clashing columns, and no rows at all."""
    rng = random.Random(3)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    text, long = prose(80), prose(30_000)
    rows = [(1, text), (1, text), (1, text), (2, text), (None, text), (None, text), (3, None), (3, None), (None, ""), (4, long), (5, prose(70))]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    table = spark.createDataFrame([(i, t, None, len(t or ""), *("c" for _ in CLASHES)) for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    near = corpus_pipeline.near_duplicates(spark, table, str(tmp_path))
    assert near.dtypes == table.dtypes
    # One row of the group stays, with the smallest id; rows without words all do.
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near.collect()) == sorted([(1, text), (3, ""), (3, ""), (0, ""), (4, long), (5, rows[-1][1])])
    cut = corpus_pipeline.repeated_passages(spark, table, str(tmp_path))
    assert cut.dtypes == table.dtypes
    assert sorted(r["doc_id"] or 0 for r in cut.collect()) == [0, 1, 1, 1, 3, 3, 4, 5]
    for empty in (False, True):
        docs = table.where("false") if empty else table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert docs.dtypes == table.dtypes
            assert (docs.count() == 0) == empty
