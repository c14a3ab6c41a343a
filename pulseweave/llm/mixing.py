"""Operator 1: mixing sources to target weights.

Temperature mixing: the token shares of the sources are raised to an exponent
between 0 (all sources alike) and 1 (as they are) and normalised.  The exponent
is bisected until the mixture has a target entropy or keeps a repetition
limit; where both are asked for, the larger exponent holds both.  The weights
are then realised as block permutations under a token budget: a source's
documents lie in a fixed number of blocks by a hash of their id; a pass over
the source is a permutation of its blocks; whole passes are made as long as
the source's part of the budget lasts, and the last pass ends with the last
block that the budget still holds in full.

Built from DataFrame functions only.  The hot source is as many groups as it
has blocks, and all sums are combined before they are shuffled.  The driver
sees 65 rows a step of the bisection, however many sources there are.

A null source is a source of its own.  Null and empty texts have no tokens;
they are in their block like other documents.  A source without tokens has
weight 0 and is passed over once.  Repeated rows are documents of their own and
lie in the same block.  An empty table gives an empty table.  Input columns
keep their names; columns of the output's names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, free

BLOCKS = 256
SEED = 42
#: Each step narrows the exponent's range this many times.
GRID = 64
STEPS = 9


def words(text: Column) -> Column:
    """The token measure of the mixture: words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def block_of(id_: Column, blocks: int = BLOCKS, seed: int = SEED) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(blocks))


def _exponent(shares: DataFrame, reached) -> float:
    """The smallest exponent in [0, 1] (to within 1e-16) at which ``reached`` holds; it holds at 1 or 1 is the answer.

    ``reached`` gets z = sum p^a, s = sum p^a ln p, and the largest and least p^(a-1).
    """
    low, high = 0.0, 1.0
    for step in range(STEPS):
        a = F.lit(low) + (F.lit(high) - F.lit(low)) * F.col("g") / F.lit(float(GRID))
        at = (
            shares.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
            .withColumn("a", a)
            .groupBy("g", "a")
            .agg(
                F.sum(F.pow("p", "a")).alias("z"),
                F.sum(F.pow("p", "a") * F.log("p")).alias("s"),
                F.max(F.pow("p", F.col("a") - 1)).alias("most"),
                F.min(F.pow("p", F.col("a") - 1)).alias("least"),
            )
            .orderBy("g")
            .limit(GRID + 1)
            .collect()
        )
        good = [r.g for r in at if reached(r)]
        if not good:
            return 1.0
        if good[0] == 0:
            return at[0].a
        low, high = at[good[0] - 1].a, at[good[0]].a
    return high


def weights(tokens: DataFrame, *, evenness: float | None = None, max_repetition: float | None = None, budget: float | str = 1.0) -> DataFrame:
    """source, n (tokens), weight, epochs (whole passes) and rest (tokens of the last, partial pass).

    ``tokens`` has source and n, one row a source.  ``evenness`` is the target
    entropy in parts of the entropy of equal weights; the exponent is the
    largest that reaches it.  ``max_repetition`` limits the passes over any
    source.  ``budget`` is the size of the mixture in parts of all tokens, or
    ``cover``: the least that passes every source once.
    """
    cover = budget == "cover"
    positive = tokens.where(F.col("n") > 0)
    total = positive.agg(F.sum("n").alias("t"), F.count("*").alias("k")).first()
    all_tokens, k = total.t or 0, total.k
    out = tokens.withColumn("n", F.coalesce("n", F.lit(0)))
    if not all_tokens:
        return out.withColumns({"weight": F.lit(0.0), "epochs": F.lit(1).cast("long"), "rest": F.lit(0.0)})
    shares = positive.select("source", "n", (F.col("n") / F.lit(float(all_tokens))).alias("p"))
    exponents = []
    if evenness is not None:
        goal = evenness * math.log(k) if k > 1 else 0.0
        # entropy falls as the exponent grows: the first exponent under the goal ends the range
        exponents.append(_exponent(shares, lambda r: math.log(r.z) - r.a * r.s / r.z <= goal))
    if max_repetition is not None:
        exponents.append(_exponent(shares, (lambda r: r.most / r.least <= max_repetition) if cover else (lambda r: r.most / r.z * float(budget) <= max_repetition)))
    a = max(exponents, default=1.0)
    z = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z")).first().z
    exact = F.pow("p", F.lit(a)) / F.lit(z)
    weighted = shares.select("source", F.round(exact, 9).alias("weight"), exact.alias("exact"))
    out = out.join(weighted, out["source"].eqNullSafe(weighted["source"]), "left").select(out["*"], F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("exact", F.lit(0.0)).alias("_exact"))
    if cover:
        # a source without tokens asks for no more; small sources have weights that round to none
        size = out.where(F.col("_exact") > 0).agg(F.max(F.col("n") / F.col("_exact")).alias("b")).first().b
    else:
        size = float(all_tokens) * float(budget)
    aim = F.col("_exact" if cover else "weight") * F.lit(float(size))
    passes = F.floor(F.round(aim / F.col("n"), 9))
    if cover:
        passes = F.greatest(passes, F.lit(1).cast("long"))
    return out.withColumn("epochs", F.when(F.col("n") > 0, passes).otherwise(1).cast("long")).withColumn("rest", F.greatest(aim - F.col("epochs") * F.col("n"), F.lit(0.0))).drop("_exact")


def schedule(blocks: DataFrame, weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """source, block, epoch, block_rank: the blocks of each pass in the order of its permutation."""
    plan = blocks.join(weighted, blocks["source"].eqNullSafe(weighted["source"])).select(blocks["*"], "weight", "epochs", "rest")
    plan = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("epoch"), F.col("block")).cast("binary"))
    w = Window.partitionBy("source", "epoch").orderBy("place", "block")
    plan = plan.withColumn("place", place).withColumns({"block_rank": F.row_number().over(w).cast("long"), "so_far": F.sum("block_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    # a block that does not fit ends the pass, and the blocks behind it reach further still
    return plan.where((F.col("epoch") < F.col("epochs")) | ((F.col("so_far") <= F.col("rest")) & (F.col("rest") > 0))).select("source", "block", "epoch", "block_rank", "weight")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source: str = "source",
    text: str = "text",
    n_tokens: str | None = None,
    evenness: float | None = None,
    max_repetition: float | None = None,
    budget: float | str = 1.0,
    blocks: int = BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """The mixture: rows of ``docs``, once for each pass that takes their block, with mix_block, mix_epoch, mix_rank and mix_weight, which take the place of columns of these names."""
    scratch = Scratch(docs.sparkSession, "mixing")
    measure = words(F.col(text)) if n_tokens is None else F.coalesce(F.col(n_tokens), F.lit(0)).cast("long")
    sized = docs.select(F.col(source).alias("source"), block_of(F.col(id_col), blocks, seed).alias("block"), measure.alias("n"))
    table = scratch.save(sized.groupBy("source", "block").agg(F.sum("n").alias("block_tokens")), "blocks")
    tokens = scratch.save(table.groupBy("source").agg(F.sum("block_tokens").alias("n")), "sources")
    weighted = weights(tokens, evenness=evenness, max_repetition=max_repetition, budget=budget)
    if max_repetition is None and (most := weighted.agg(F.max("epochs")).first()[0] or 0) > MOST_PASSES:
        raise ValueError(f"a source would be passed {most} times: give max_repetition")
    plan = scratch.save(schedule(table, weighted, seed), "schedule")
    at, mixed = free(docs.columns, "_at", "_mix")
    chosen = plan.select(F.struct("source", "block").alias(at), F.struct("epoch", "block_rank", "weight").alias(mixed))
    keyed = docs.withColumn(at, F.struct(F.col(source).alias("source"), block_of(F.col(id_col), blocks, seed).alias("block")))
    out = keyed.join(chosen, keyed[at].eqNullSafe(chosen[at]))
    new = dict(zip(_NEW, (keyed[at]["block"], F.col(mixed)["epoch"], F.col(mixed)["block_rank"], F.col(mixed)["weight"]), strict=True))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in _NEW], *[c.alias(n) for n, c in new.items()])


#: Without a limit on repetition no source is passed more often.
MOST_PASSES = 4096
_NEW = ("mix_block", "mix_epoch", "mix_rank", "mix_weight")
