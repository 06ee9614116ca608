"""Temperature mixing: sources drawn by tempered token shares, as budgeted block permutations.

Source i with token share p_i gets weight p_i ** alpha, normalised. alpha comes from
bisection: the largest that reaches a target entropy, raised where needed to the smallest
under which no source is repeated more than a limit. Each weight is a token budget. A
source's documents lie in blocks; an epoch is a permutation of its blocks, and the budget
takes whole epochs and then a prefix of one more. Everything is built-in DataFrame
functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, unit_hash

#: Blocks that one task orders; a source with more has its permutation ordered in parts.
PART_BLOCKS = 1 << 12
#: Points of an interval that one pass over the sources looks at, and passes: together they
#: narrow alpha as far as 54 halvings, less than the spacing of doubles below 1.
POINTS, PASSES = 64, 9


@dataclass(frozen=True)
class Mix:
    """entropy: the target as a share of the largest possible, ln(sources). repeats: the most
    epochs of a source. budget: all tokens to draw, by default as many as there are.
    block_tokens: about the tokens of a block, within which one task orders the documents.
    """

    entropy: float = 0.95
    repeats: float = 4.0
    budget: int | None = None
    block_tokens: int = 1 << 16
    seed: int = 0


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up; 0 for null and empty text."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def source_tokens(docs: DataFrame, source_col: str, tokens: Column) -> DataFrame:
    """source and tokens of each source that has any."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens).alias("tokens")).where("tokens > 0")


def temperature(sources: DataFrame, mix: Mix) -> float:
    """alpha for a table of sources.

    Entropy falls and the least share's repeats fall as alpha grows, so both borders are
    bisected; a pass over the sources halves both intervals as often as POINTS allow. Only
    sums for each point reach the driver.
    """
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    logs = sources.select(F.log(F.col("tokens") / F.lit(float(total))).alias("l"))
    target, budget = mix.entropy * math.log(n), (mix.budget or total) / total

    def looked_at(alphas: list[float]) -> dict[float, tuple[bool, bool]]:
        """Whether the entropy is reached, and whether a source is repeated too often."""
        at = logs.withColumn("a", F.explode(F.array(*(F.lit(a) for a in alphas))))
        power = F.exp(F.col("a") * F.col("l"))
        sums = at.groupBy("a").agg(F.sum(power), F.sum(power * F.col("l")), F.max((F.col("a") - 1.0) * F.col("l"))).collect()
        return {a: (math.log(z) - a * weighted / z >= target, math.exp(most) / z * budget > mix.repeats) for a, z, weighted, most in sums}

    ends = looked_at([0.0, 1.0])
    borders = [[1.0, 1.0] if ends[1.0][k] else [0.0, 1.0] for k in (0, 1)]
    if not ends[0.0][1]:
        borders[1] = [0.0, 0.0]
    for _ in range(PASSES):
        points = [[low + (high - low) * i / POINTS for i in range(1, POINTS)] if low < high else [] for low, high in borders]
        seen = looked_at(sorted({a for p in points for a in p})) if any(points) else {}
        for k, (low, high) in enumerate(borders):
            for a in points[k]:  # the property holds up to the border
                if seen[a][k]:
                    low = a
                else:
                    high = a
                    break
            borders[k] = [low, high]
    # The largest alpha that reaches the entropy, or the smallest without too many repeats.
    return max(borders[0][0], borders[1][1])


def budgets(sources: DataFrame, alpha: float, mix: Mix) -> DataFrame:
    """source, tokens and budget (tokens to draw) of each source."""
    sums = sources.agg(F.sum("tokens").alias("total"))
    shares = sources.join(F.broadcast(sums), F.lit(True)).withColumn("power", F.exp(F.lit(alpha) * F.log(F.col("tokens") / F.col("total").cast("double"))))
    norm = shares.agg(F.sum("power").alias("z"))
    budget = F.lit(mix.budget) if mix.budget is not None else F.col("total")
    return shares.join(F.broadcast(norm), F.lit(True)).select("source", "tokens", F.floor(F.col("power") / F.col("z") * budget).cast("long").alias("budget"))


def draw(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, source, tokens, epoch, block, start: one row for each drawing of a document.

    whole: with the drawn row of docs as a struct in column row, whatever its columns' names.

    start is the number of the source's tokens drawn before. A document is drawn in the
    last, unfinished epoch if its drawing begins within the budget, so that a source is at
    most one document over. Documents without tokens are drawn in no epoch; a null source
    is a source of its own, a null id an id of its own; repeated rows are drawn each for
    itself; an empty table draws nothing; other columns are not read.
    """
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), estimated_tokens(F.col(text_col)).alias("tokens"), *rest).where("tokens > 0")
    scratch = Scratch(docs.sparkSession, "mix")
    sources = scratch.store(source_tokens(rows, "source", F.col("tokens")), "sources")
    plan = budgets(sources, temperature(sources, mix), mix)
    plan = plan.select(
        "source", "tokens", "budget",
        F.ceil(F.col("tokens") / mix.block_tokens).cast("long").alias("blocks"),
        F.expr("budget div tokens").alias("epochs"),
        F.expr("budget % tokens").alias("rest"),
    )
    plan = scratch.store(plan, "plan")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    by_source = plan.select(F.col("source").alias("own"), "blocks", "budget", F.col("tokens").alias("all"), "epochs", "rest")
    placed = rows.join(by_source, F.col("source").eqNullSafe(F.col("own"))).drop("own").withColumn("block", unit_hash(key, F.lit("block"), F.lit(str(mix.seed))) % F.col("blocks"))
    # Per block and epoch: what comes before it in the epoch's permutation of blocks.
    sizes = placed.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.first("blocks").alias("blocks"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), F.first("all").alias("all"))
    runs = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs")))).where("epoch < epochs OR rest > 0")
    turn = unit_hash(F.coalesce("source", F.lit("null")), F.col("block").cast("string"), F.col("epoch").cast("string"), F.lit(str(mix.seed)))
    # The order of turns is cut into parts; each part's sum, then the sums within one.
    parts = F.ceil(F.col("blocks") / PART_BLOCKS)
    runs = runs.withColumn("turn", turn).withColumn("part", F.floor(F.col("turn") / F.lit(2.0**60) * parts)).drop("blocks")
    sums = runs.groupBy("source", "epoch", "part").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("part").alias("p"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("earlier"))
    order = Window.partitionBy("source", "epoch", "part").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    runs = runs.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("part") == F.col("p"))).withColumn("before", F.col("before") + F.col("earlier"))
    runs = runs.where("epoch < epochs OR before < rest")
    runs = runs.select(F.col("source").alias("own"), F.col("block").alias("at"), "epoch", "before", F.expr("epoch * all").alias("done"), F.expr("CASE WHEN epoch < epochs THEN all ELSE rest END").alias("limit"))
    drawn = placed.select("doc_id", "source", "tokens", "block", *(["row"] if whole else [])).join(runs, F.col("source").eqNullSafe(F.col("own")) & (F.col("block") == F.col("at")))
    turn = unit_hash(key, F.col("epoch").cast("string"), F.lit(str(mix.seed)))
    inside = Window.partitionBy("source", "block", "epoch").orderBy(turn, "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("offset", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).where("offset < limit")
    return drawn.select("doc_id", "source", "tokens", "epoch", "block", (F.col("done") + F.col("offset")).alias("start"), *(["row"] if whole else []))
