"""Temperature mixing of sources, realised as budgeted block permutations.

Token shares of sources are raised to an exponent found by bisection, so that the normalised weights
meet a target entropy, or so that no source repeats more often than a limit. A source's rows lie in
blocks; each pass goes through the blocks in a permuted order, and the last pass stops where the
source's token budget ends. Rows never move: every decision is a comparison with a few numbers that
each source has, so one narrow pass over the rows makes the mixture.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialise, named

#: Tokens of one block, about.
BLOCK_TOKENS = 1 << 20
#: Sources up to which their parameters are broadcast (about 100 bytes each); beyond, a plain join deals them.
BROADCAST_SOURCES = 100_000


def word_tokens(text: str = "text") -> Column:
    """White-space separated words of a text; null and blank texts have none."""
    t = F.trim(F.regexp_replace(F.coalesce(named(text).cast("string"), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def bisect(f: Callable[[float], float], target: float, rising: bool) -> float:
    """The exponent in [0, 1] at which a monotone f meets the target; an end of the range if it never does."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if (f(mid) < target) == rising:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def temperature_weights(tokens: dict, exponent: float) -> dict:
    """Normalised weights: shares to the power of the exponent. Sources without tokens weigh nothing."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    z = sum(raw.values())
    return {s: w / z if z else 0.0 for s, w in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def repetitions(tokens: dict, exponent: float) -> dict:
    """Passes over each source when the source that repeats least is read exactly once; no row is lost."""
    most = max(tokens.values(), default=0)
    return {s: (most / n) ** (1 - exponent) if n else 1.0 for s, n in tokens.items()}


#: Exponents that one pass over the sources tries between the ends of the bracket.
TRIES = 12


def exponent(totals: DataFrame, max_repeat: float | None, target_entropy: float | None) -> tuple[float, int]:
    """The exponent that meets a limit on repetitions or a target entropy (natural log), and the largest source's tokens.

    totals (s, n): tokens of each source, of which there may be any number: the bisection reads
    aggregates over them. The smallest source repeats most, (largest / smallest) ** (1 - exponent) times,
    so two numbers decide a limit on repetitions; the entropy at TRIES exponents is one pass, which
    narrows the bracket that many times over.
    """
    some = totals.where("n > 0")
    ends = some.agg(F.min("n"), F.max("n")).first()
    if ends[0] is None:
        return 1.0, 0
    least, most = int(ends[0]), int(ends[1])
    if target_entropy is None:
        return bisect(lambda e: (most / least) ** (1 - e), max_repeat, rising=False), most
    lo, hi = 0.0, 1.0
    for _ in range(8):  # the bracket shrinks to about 1e-9
        tries = [lo + (hi - lo) * (i + 1) / (TRIES + 1) for i in range(TRIES)]
        x = F.log(F.col("n") / F.lit(most))  # at most 0, so no power overflows
        sums = some.agg(*[F.struct(F.sum(F.exp(x * e)).alias("z"), F.sum(x * e * F.exp(x * e)).alias("y")).alias(f"e{i}") for i, e in enumerate(tries)]).first()
        low = [math.log(t.z) - t.y / t.z < target_entropy for t in sums]  # entropy falls as the exponent grows
        first = low.index(True) if True in low else TRIES
        lo, hi = (tries[first - 1] if first else lo), (tries[first] if first < TRIES else hi)
    return (lo + hi) / 2, most


def mix_sources(docs: DataFrame, max_repeat: float | None = 1.5, target_entropy: float | None = None, tokens: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs, each row once for every pass that reads it, with mix_pass (from 1), mix_block and mix_order.

    The source that repeats least is read exactly once, so every row stays; the others are read up to
    max_repeat times. (mix_pass, mix_block, mix_order) is the order of a source's permuted passes. A
    null source is a source of its own; rows without tokens (null and empty texts) appear once; texts of
    any length are counted whole; equal rows share one fate; input columns named like the new ones or
    starting with _mix_ are dropped. An empty table gives an empty result.

    Texts are tokenised once, into a slim table (source, tokens, key); every decision is made on that,
    by aggregates of sources and blocks, and no list of sources comes to the driver.
    """
    docs = docs.drop("mix_pass", "mix_block", "mix_order", *[c for c in docs.columns if c.startswith("_mix_")])
    spark = docs.sparkSession
    source, n = named(source_col), word_tokens(text_col) if tokens is None else tokens
    blank = ~F.coalesce(named(text_col).cast("string").rlike(r"\S"), F.lit(False)) if tokens is None else F.coalesce(n, F.lit(0)) == 0
    slim = materialise(spark, docs.select(source.cast("string").alias("s"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), _row_key(id_col, seed).alias("k")))
    totals = materialise(spark, slim.groupBy("s").agg(F.sum("n").alias("n")))
    sources = totals.count()
    e, most = exponent(totals, max_repeat, target_entropy)
    repeat = F.when(F.col("n") > 0, F.pow(F.lit(float(most)) / F.col("n"), F.lit(1 - e))).otherwise(1.0)
    plan = totals.select("s", F.greatest(F.lit(1), F.ceil(F.col("n") / block_tokens)).cast("long").alias("blocks"), repeat.alias("r"), "n")
    plan = plan.withColumn("full", F.floor(F.col("r") + 1e-9).cast("int")).withColumn("left", (F.col("r") - F.col("full")) * F.col("n"))
    plan = materialise(spark, plan.select("s", "blocks", "full", F.when(F.col("left") >= 1, F.col("left")).otherwise(0.0).alias("left")))

    # The block in which the last pass ends: blocks in permuted order, by the running sum of their tokens.
    keyed = _join(slim, plan.where("left > 0"), sources)
    keyed = keyed.withColumn("bk", _block_key(F.col("s"), F.pmod("k", F.col("blocks")), seed))
    sums = keyed.groupBy("s", "bk", "left").agg(F.sum("n").alias("n"))
    run = F.sum("n").over(Window.partitionBy("s").orderBy("bk").rowsBetween(Window.unboundedPreceding, 0))
    cut = sums.withColumn("before", run - F.col("n")).where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("n") > F.col("left")))
    cut = materialise(spark, cut.select("s", F.col("bk").alias("cut"), (F.col("left") - F.col("before")).alias("rest")))

    # The row in that block at which it ends; a block is a bounded number of tokens.
    ending = cut.withColumnRenamed("s", "c").join(plan.select("s", "blocks"), F.col("c").eqNullSafe(F.col("s"))).drop("c")
    inside = _join(slim, ending, sources)
    inside = inside.where(_block_key(F.col("s"), F.pmod("k", F.col("blocks")), seed) == F.col("cut"))
    # Ordered by the key alone: equal rows share a key, and the running sum by range takes them together.
    run = F.sum("n").over(Window.partitionBy("s").orderBy("k"))
    ends = inside.withColumn("run", run).where(F.col("run") <= F.col("rest")).groupBy("s").agg(F.max("k").alias("end"))

    some = plan.select("s", "blocks", "full")
    params = some.join(cut.select(F.col("s").alias("c"), "cut"), F.col("s").eqNullSafe(F.col("c")), "left").join(ends.select(F.col("s").alias("d"), "end"), F.col("s").eqNullSafe(F.col("d")), "left")
    params = materialise(spark, params.select(*[F.col(c).alias(f"_mix_{c}") for c in ("s", "blocks", "full", "cut", "end")]))
    rows = docs.select(*columns(docs), source.cast("string").alias("_mix_source"), _row_key(id_col, seed).alias("_mix_k"), blank.alias("_mix_blank"))
    rows = rows.join(F.broadcast(params) if sources <= BROADCAST_SOURCES else params, F.col("_mix_source").eqNullSafe(F.col("_mix_s")))
    rows = rows.withColumn("_mix_bk", _block_key(F.col("_mix_source"), F.pmod("_mix_k", F.col("_mix_blocks")), seed))
    again = (F.col("_mix_bk") < F.col("_mix_cut")) | ((F.col("_mix_bk") == F.col("_mix_cut")) & (F.col("_mix_k") <= F.col("_mix_end")))
    passes = F.when(F.col("_mix_blank"), 1).otherwise(F.col("_mix_full") + F.coalesce(again, F.lit(False)).cast("int"))
    rows = rows.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), passes)))
    rows = rows.withColumn("mix_block", F.xxhash64("_mix_bk", "mix_pass")).withColumn("mix_order", F.xxhash64("_mix_k", "mix_pass"))
    return rows.select(*columns(docs), "mix_pass", "mix_block", "mix_order")


def _row_key(id_col: str, seed: int) -> Column:
    return F.xxhash64(named(id_col).cast("string"), F.lit(seed))


def _block_key(source: Column, block: Column, seed: int) -> Column:
    return F.xxhash64(F.coalesce(source, F.lit("\0")), block, F.lit(seed))


def _join(rows: DataFrame, params: DataFrame, sources: int) -> DataFrame:
    """Rows with their source's parameters, which are broadcast up to a number of sources."""
    params = params.withColumnRenamed("s", "_s")
    return rows.join(F.broadcast(params) if sources <= BROADCAST_SOURCES else params, F.col("s").eqNullSafe(F.col("_s"))).drop("_s")
