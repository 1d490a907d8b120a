"""Scores of predictions and retrieval; undefined ratios are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.when(b != 0, F.round(a / b, digits))


def confusion(rows: DataFrame, truth: str, guess: str, *keys: str) -> DataFrame:
    """Cells, accuracy and macro F1 of two classes, per ``keys``."""
    cell = lambda t, g: F.sum(((F.col(truth) == t) & (F.col(guess) == g)).cast("long")).alias(f"n{t}{g}")
    c = rows.groupBy(*keys).agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1), F.count("*").alias("n"))
    f0, f1 = ((2 * F.col(a)) / (2 * F.col(a) + F.col("n01") + F.col("n10")) for a in ("n00", "n11"))
    safe = lambda f, a: F.when(2 * F.col(a) + F.col("n01") + F.col("n10") > 0, f).otherwise(0.0)
    return c.withColumn("accuracy", F.round((F.col("n00") + F.col("n11")) / F.col("n"), 6)).withColumn("macro_f1", F.round((safe(f0, "n00") + safe(f1, "n11")) / 2, 6))


def mean_pool(logits: DataFrame) -> DataFrame:
    """(document, label, m0, m1, guess): mean logits; a tie is class 0."""
    m = logits.groupBy("document", "label").agg(F.round(F.avg("l0"), 6).alias("m0"), F.round(F.avg("l1"), 6).alias("m1"))
    return m.withColumn("guess", (F.col("m1") > F.col("m0")).cast("int"))


def vote_pool(logits: DataFrame) -> DataFrame:
    """(document, label, votes, guess): the class with most windows; a tie is the lower class."""
    v = logits.withColumn("g", (F.col("l1") > F.col("l0")).cast("int")).groupBy("document", "label", "g").agg(F.count("*").alias("votes"))
    first = F.row_number().over(Window.partitionBy("document").orderBy(F.desc("votes"), "g"))
    return v.withColumn("k", first).filter("k = 1").select("document", "label", "votes", F.col("g").alias("guess"))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of overlapping windows that tile ``n`` tokens, the last one pinned to the end."""
    last = n - size
    steps = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(size - overlap))
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(steps, F.array(last))))


SALTS = 16
NEAR = 2e-4
"""How far from a share the sketch brackets it; the sketch errs by a quarter of this at most."""

SMALL = 20_000
"""Values up to which a group is its own bracket, as ranks are rounded."""


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, one column per name in ``shares``): exact percentiles by linear interpolation, of groups of any size; nulls don't count.

    A sketch of each group brackets every wanted rank by two values; a second pass
    counts what lies below a bracket and each value inside it. Only values inside
    a bracket, some three NEAR of a group or SMALL, come together in one task.
    """
    v, names = F.col(value), list(shares)
    low, high = ([min(max(p + d, 0.0), 1.0) for p in shares.values()] for d in (-NEAR, NEAR))
    sketch = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.percentile_approx(v, [*low, *high], int(4 / NEAR)).alias("_at"))
    end = lambda edge, i: F.when(F.col("n") <= SMALL, F.col(edge)).otherwise(F.col("_at")[i])
    wanted = F.array(*[F.named_struct(F.lit("i"), F.lit(i), F.lit("rank"), p * (F.col("n") - 1), F.lit("low"), end("_min", i), F.lit("high"), end("_max", i + len(names))) for i, p in enumerate(shares.values())])
    brackets = sketch.filter("n > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], wanted.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.filter(v.isNotNull()).select(*keys, v.alias("_v"), F.pmod(F.xxhash64(v), F.lit(SALTS)).cast("int").alias("salt"))
    same = F.col("salt") == F.col("_salt")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = salted.join(brackets, same).select(*keys, "_v", F.explode("_w").alias("w")).filter(F.col("_v") <= F.col("w.high"))
    by = [*keys, "i", "rank"]
    counts = met.groupBy(*keys, F.col("w.i").alias("i"), F.col("w.rank").alias("rank"), F.when(F.col("_v") >= F.col("w.low"), F.col("_v")).alias("x")).agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0))
    below = F.floor("rank")
    found = counts.withColumn("up_to", up_to).groupBy(*by).agg(F.min(F.when(F.col("up_to") > below, F.struct(F.col("x").alias("x"))))["x"].alias("a"), F.min(F.when(F.col("up_to") > F.ceil("rank"), F.struct(F.col("x").alias("x"))))["x"].alias("b"))
    # an empty end of a bracket would mean that the sketch erred by more than it may
    sure = lambda c: F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double"))
    between = F.when(F.col("a") == F.col("b"), sure("a")).otherwise((F.ceil("rank") - F.col("rank")) * sure("a") + (F.col("rank") - below) * sure("b"))
    each = found.select(*keys, "i", between.alias("p")).unionByName(sketch.select(*keys, "n"), allowMissingColumns=True)
    return each.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("p"))).alias(name) for i, name in enumerate(names)])
