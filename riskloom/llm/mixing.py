"""Mixing sources to target weights by a temperature and budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise

#: Share of the largest possible entropy that the mixture keeps, if the sources allow it.
TARGET_ENTROPY = 0.95
#: Times that the tokens of any source may be repeated.
MAX_REPETITION = 4.0
#: Tokens of the mixture over the tokens of the input.
BUDGET = 1.0
SEED = 7
#: The exponent is found to 32 ** -PASSES; every pass narrows the bracket by 32.
PASSES = 6
#: Documents of a permutation block, about.
BLOCK_DOCS = 10_000


@dataclass
class Mixture:
    """Per source: tokens, weight, whole passes and the last key of the partial pass; and the exponent."""

    plan: DataFrame
    alpha: float


def n_tokens() -> Column:
    """Tokens of a text: words separated by ASCII white space; a NULL text has none."""
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def permutation_key(seed: int) -> Column:
    """Position of a document in its source's permutation, the same whatever the partitioning; NULL ids tie."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def solve_exponent(sources: DataFrame, target: float, repetition: float, budget: float) -> float:
    """Largest exponent in [0, 1] at which entropy still reaches ``target`` or some source still repeats too often.

    Both hold below a point and fail above it.  A pass evaluates 33 exponents in
    one aggregate over the sources, so only sums come to the driver, however
    many sources there are.
    """
    size = sources.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    if not size["n"]:
        return 1.0
    share = F.col("tokens") / F.lit(float(size["t"]))
    need = target * math.log(size["n"])
    low, width = 0.0, 1.0
    for _ in range(PASSES):
        width /= 32
        grid = [min(1.0, low + j * width) for j in range(33)]
        sums = [f(F.pow(share, F.lit(a)), share, a) for a in grid for f in (
            lambda w, s, a: F.sum(w), lambda w, s, a: F.sum(w * F.log(s)), lambda w, s, a: F.max(w / s))]
        got = list(sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first())
        for j, a in enumerate(grid):
            z, zl, top = got[3 * j:3 * j + 3]
            if not (math.log(z) - a * zl / z >= need or budget * top / z > repetition):
                break
            low = a
    return low


def mixture(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, budget: float = BUDGET, seed: int = SEED) -> Mixture:
    """The plan (source, tokens, weight, passes, last_key) of the mixture.

    Weights are token shares to the power alpha, normalised.  Each source gets
    ``weight * budget * all tokens``: whole passes, then a prefix of its
    permutation that stays within what is left.  Blocks of keys are summed on
    the map side; only the one block per source in which the budget ends is
    ordered document by document.  A NULL source is a source of its own.
    Sources without tokens have no weight.
    """
    rows = docs.select("source", n_tokens().alias("n"), permutation_key(seed).alias("key")).where("n > 0")
    rows = materialise(rows, "keys")
    totals = rows.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    totals = materialise(totals, "sources")
    alpha = solve_exponent(totals, target_entropy, max_repetition, budget)
    size = totals.agg(F.sum("tokens").alias("t"), F.max("docs").alias("d")).first()
    total, most = float(size["t"] or 1), size["d"] or 1
    power = F.pow(F.col("tokens") / F.lit(total), F.lit(alpha))
    norm = totals.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    weights = totals.withColumn("weight", power / F.lit(norm))
    share = F.floor(F.col("weight") * F.lit(budget * total) + 0.5).cast("bigint")
    weights = weights.withColumn("passes", F.expr("0").cast("bigint") + F.floor(share / F.col("tokens"))).withColumn("rest", share - F.col("passes") * F.col("tokens"))
    weights = materialise(weights.select("source", "tokens", "weight", "passes", "rest"), "weights")
    digits = 1
    while BLOCK_DOCS * 16 ** digits < most:
        digits += 1
    block = F.substring("key", 1, digits)
    blocks = rows.groupBy("source", block.alias("block")).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ends = blocks.withColumn("before", before).join(weights.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    ends = materialise(ends.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))).select("s", "block", "before", "rest"), "ends")
    last = rows.withColumn("b", block).join(ends, (F.col("b") == F.col("block")) & F.col("source").eqNullSafe(F.col("s")))
    running = F.sum("n").over(Window.partitionBy("s").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    taken = last.withColumn("upto", F.col("before") + running).where("upto <= rest").groupBy("s").agg(F.max("key").alias("inside"))
    keys = ends.join(taken.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", F.coalesce("inside", "block").alias("last_key"))
    plan = weights.join(keys, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "tokens", "weight", "passes", F.coalesce("last_key", F.lit("")).alias("last_key"))
    return Mixture(materialise(plan, "plan"), alpha)


def _with_copies(docs: DataFrame, mix: Mixture, seed: int) -> DataFrame:
    plan = mix.plan.select(F.col("source").alias("__mx_source"), F.col("weight").alias("__mx_weight"), F.col("passes").alias("__mx_passes"), F.col("last_key").alias("__mx_last"))
    rows = docs.withColumn("__mx_n", n_tokens())
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("__mx_source")), "left")
    partial = (permutation_key(seed) <= F.col("__mx_last")).cast("bigint")
    return joined.withColumn("__mx_copies", F.when(F.col("__mx_n") > 0, F.col("__mx_passes") + partial).otherwise(F.lit(1).cast("bigint")))


def copies(docs: DataFrame, seed: int = SEED, **targets: float) -> DataFrame:
    """(doc_id, source, n_tokens, copies, weight): how often each document stands in the mixture.

    A document without tokens costs nothing and stays once.  Repeated rows share
    their key and are taken or left together.
    """
    found = _with_copies(docs.select("doc_id", "source", "text"), mixture(docs, seed=seed, **targets), seed)
    return found.select("doc_id", "source", F.col("__mx_n").alias("n_tokens"), F.col("__mx_copies").alias("copies"), F.col("__mx_weight").alias("weight"))


def mix(docs: DataFrame, seed: int = SEED, **targets: float) -> DataFrame:
    """``docs`` with every row repeated as often as the mixture wants it, columns unchanged."""
    found = _with_copies(docs, mixture(docs, seed=seed, **targets), seed)
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__mx_copies")))
    return found.where("__mx_copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns], times.alias("__mx_copy")).drop("__mx_copy")
