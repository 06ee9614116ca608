"""Distribution divergence: documents against the character and word habits of their language.

A document's histograms of character classes and of its language's common words are
compared with the language's reference by Jensen-Shannon distance. References are fitted on
trusted documents alone, so that what else is in a corpus moves no verdict. Everything is
built-in DataFrame functions.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, words

#: Forty common words of each language (fixed values); a document's other words are one more class.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit nicht ist für auf im sich des dem ein eine als auch es an werden aus er hat dass sie nach bei um am sind noch wie einem über so zum".split(),
    "en": "the of and to in a that is for it with by on was as are at be this from or his have an not which but had they he were their one you all we has been more when".split(),
    "es": "de la que el en y los del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también".split(),
    "fr": "de la le et les des en un une que pour qui dans du il est par sur plus au ne se pas ce avec son sa ses ou sont cette elle mais comme nous je on aux leur tout".split(),
}
#: A sign for each of a language's words.
SIGNS = string.ascii_letters[:40]
#: Classes of characters: lower case a-z, other than ASCII, A-Z, digits, other ASCII signs,
#: and separators; the same order in every histogram.
CLASSES = ("lower", "beyond_ascii", "upper", "digit", "sign", "separator")
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Largest distances, and the least sizes at which a distance is looked at."""

    classes: float = 0.20
    words: float = 0.30
    min_chars: int = 300
    min_words: int = 100


def _measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang, the base counts, and both histograms as arrays of counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), text.alias("text"))
    rows = rows.withColumn("ws", words(F.col("text")))
    rows = rows.withColumn("hs", F.transform("ws", lambda w: F.xxhash64(w)))
    windows = ", ".join(f"get(hs, i + {k})" for k in range(WINDOW))
    rows = rows.withColumn("windows", F.expr(f"CASE WHEN size(hs) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(hs) - {WINDOW}), i -> xxhash64({windows})) END"))
    # Where a window's hash occurs again: sorted with its place, it has an equal neighbour.
    rows = rows.withColumn(
        "sorted",
        F.expr("CASE WHEN size(windows) = size(array_distinct(windows)) THEN NULL ELSE array_sort(transform(windows, (h, i) -> struct(h AS h, i AS i))) END"),
    )
    rows = rows.withColumn(
        "places",
        F.expr("array_sort(transform(filter(sorted, (x, k) -> coalesce(x.h = get(sorted, k - 1).h, false) OR coalesce(x.h = get(sorted, k + 1).h, false)), x -> x.i))"),
    )
    covered = F.expr(f"coalesce(aggregate(transform(places, (p, k) -> least({WINDOW}L, coalesce(cast(get(places, k + 1) - p AS bigint), {WINDOW}L))), 0L, (s, x) -> s + x), 0L)")
    # Each step takes a class of characters out, so that the later ones run over little text.
    rows = rows.withColumn("t1", F.regexp_replace("text", r"[a-z]+", ""))
    rows = rows.withColumn("t2", F.regexp_replace("t1", r"[\x20\x09-\x0D]+", ""))
    rows = rows.withColumn("t3", F.regexp_replace("t2", r"[^\x00-\x7F]+", ""))
    rows = rows.withColumn("t4", F.regexp_replace("t3", r"[A-Z]+", ""))
    rows = rows.withColumn("t5", F.regexp_replace("t4", r"[0-9]+", ""))
    size = {k: F.length(k).cast("long") for k in ("text", "t1", "t2", "t3", "t4", "t5")}
    lines = "filter(split(text, '\\n'), l -> btrim(l, ' \\t\\n\\u000b\\f\\r') <> '')"
    rows = rows.withColumn("lines", F.expr(lines))
    rows = rows.withColumn("common", F.filter(F.transform("ws", F.lower), lambda w: _in_language(w)))
    rows = rows.withColumn("listed", F.array_join(F.transform("common", _sign), ""))
    rows = rows.withColumn("n_words", F.size("ws").cast("long"))
    return rows.select(
        "doc_id", "lang", "n_words",
        (size["text"] - size["t1"] + size["t2"]).alias("word_chars"),
        (size["t5"] - F.length(F.regexp_replace("t5", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.array(size["text"] - size["t1"], size["t2"] - size["t3"], size["t3"] - size["t4"], size["t4"] - size["t5"], size["t5"], size["t1"] - size["t2"]).alias("classes"),
        _word_counts().alias("commons"),
    )


def _in_language(w: Column) -> Column:
    test = F.lit(False)
    for lang, common in COMMON_WORDS.items():
        test = F.when(F.col("lang") == lang, w.isin(common)).otherwise(test)
    return test


def _sign(w: Column) -> Column:
    """The sign of a common word of the language."""
    out = F.lit("")
    for lang, common in COMMON_WORDS.items():
        signs = F.create_map(*(F.lit(x) for pair in zip(common, SIGNS, strict=True) for x in pair))
        out = F.when(F.col("lang") == lang, F.element_at(signs, w)).otherwise(out)
    return out


def _word_counts() -> Column:
    """Counts of the language's common words and of all other words; null for other languages."""
    each = [(F.length("listed") - F.length(F.replace("listed", F.lit(x)))).cast("long") for x in SIGNS]
    return F.when(F.col("lang").isin(list(COMMON_WORDS)), F.array(*each, F.col("n_words") - F.size("common")))


def _distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts; null if one is null or 0."""
    return F.expr(f"""
        CASE WHEN aggregate({p}, 0L, (s, x) -> s + x) > 0 AND aggregate({q}, 0L, (s, x) -> s + x) > 0 THEN
        sqrt(greatest(0D, aggregate(zip_with(
            transform({p}, x -> x / cast(aggregate({p}, 0L, (s, y) -> s + y) AS double)),
            transform({q}, x -> x / cast(aggregate({q}, 0L, (s, y) -> s + y) AS double)),
            (a, b) -> CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) / 2 ELSE 0D END
                    + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) / 2 ELSE 0D END
        ), 0D, (s, x) -> s + x))) END
    """)


def references(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a language: the histograms of its trusted documents together.

    labels: doc_id, quality and toxic; trusted are documents of quality 1 that aren't toxic.
    """
    good = labels.where("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    n, k = len(CLASSES), len(SIGNS) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.get("commons", F.lit(i))).alias(f"w{i}") for i in range(k)]
    found = measured.join(good, "doc_id", "left_semi").groupBy("lang").agg(*sums)
    return found.select(
        "lang",
        F.array(*(F.coalesce(f"c{i}", F.lit(0).cast("long")) for i in range(n))).alias("ref_classes"),
        F.array(*(F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(k))).alias("ref_commons"),
    )


def judge(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:  # noqa: B008
    """doc_id, n_words, the base counts, base_failed, kept and both distances of every row.

    References are those of labelled good rows of docs (labels: doc_id, quality, toxic). A
    document is kept unless base_failed (fewer than 20 words, or over 30 % of its words in
    repeated 8-word windows) or a distance is over its limit; a distance counts only from its
    least size on, in languages with trusted documents, and that of common words only in
    languages with a list. Null text has no words; a null language is a language of its own; a
    null id stays null and is never trusted; rows with one id are trusted together; equal rows
    give equal results, each its own row; a distance at its limit is no failure; very long
    texts are measured as a whole; an empty table gives an empty one; other columns are not
    read.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    measured = scratch.store(_measured(docs, id_col, text_col, lang_col), "measured")
    known = scratch.store(references(measured, labels), "references")
    rows = measured.withColumnRenamed("lang", "own").join(known, F.col("own").eqNullSafe(F.col("lang")), "left")
    rows = rows.withColumn("class_distance", F.when(F.col("word_chars") >= limits.min_chars, _distance("classes", "ref_classes")))
    rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= limits.min_words, _distance("commons", "ref_commons")))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > limits.classes) | (F.coalesce("word_distance", F.lit(0.0)) > limits.words)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ~odd).alias("kept"), "class_distance", "word_distance",
    )
