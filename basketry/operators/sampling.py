"""Sampling (P1, P2) and size variants.

Samples are md5 buckets of (seed, basket id): the same rows on every run,
under any partitioning, and reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import TWO_32, in_sample, md5_unit

# Fixed values of the reference: the confidence parameter delta and the
# default alpha used by its sample-size formulas.
DELTA = 0.1
ALPHA_IN_USE = 0.1
ALPHA_OLD = 0.01


def sample_baskets(baskets: DataFrame, fraction: float, seed: int = 42,
                   method: str = "md5") -> DataFrame:
    """Bernoulli sample without replacement.

    ``md5`` (default) is stable under repartitioning and matches SQL;
    ``bernoulli`` uses ``DataFrame.sample`` (fraction clamped to 1).
    """
    f = min(1.0, max(0.0, float(fraction)))
    if method == "bernoulli":
        return baskets.sample(withReplacement=False, fraction=f, seed=seed)
    return baskets.where(in_sample(seed, F.col("basket_id"), f))


def sample_size_expr(n, threshold, eps, alpha) -> F.Column:
    """(a) the formula in use: ceil(5 * 2n ln(1/eps) / ((1 - alpha)^2 t))."""
    return F.ceil(F.lit(5.0) * (F.log(F.lit(1.0) / eps) * F.lit(2.0) * n)
                  / (F.pow(F.lit(1.0) - alpha, 2) * threshold)).cast("long")


def sample_plan(params: DataFrame) -> DataFrame:
    """Adds ``sample_size``, ``fraction`` and ``scaled_threshold`` (formula
    (a)) and the two older sizes (b) and (c) to rows ``(n, threshold, epsilon,
    alpha)``. The fraction is clamped to 1 and the threshold scaled by the
    clamped fraction."""
    n, t, e, a = F.col("n"), F.col("threshold"), F.col("epsilon"), F.col("alpha")
    size = sample_size_expr(n, t, e, a)
    frac = F.least(F.lit(1.0), size / n)
    size_b = (F.lit(2) * F.ceil((F.log(F.lit(1.0) / e) * F.lit(2.0) * n)
                                / (F.lit(1.0 - ALPHA_OLD) * F.lit(DELTA ** 2) * t))).cast("long")
    size_c = (F.lit(2.0) * n * F.log(F.lit(1.0) / e)) / (t * F.lit(DELTA ** 2) * F.lit(1.0 - ALPHA_IN_USE))
    return params.select("*", size.alias("sample_size"), frac.alias("fraction"),
                         (t * frac).alias("scaled_threshold"),
                         size_b.alias("sample_size_b"), size_c.alias("sample_size_c"))


def sample_fraction(n: int, threshold: float, eps: float, alpha: float = ALPHA_IN_USE) -> tuple[int, float]:
    """Driver-side scalar version of P2(a): (sample_size, clamped fraction)."""
    import math
    size = int(math.ceil(5 * (math.log(1 / eps) * 2 * n) / ((1 - alpha) ** 2 * threshold)))
    return size, min(1.0, size / n) if n else 1.0


def size_variants(baskets: DataFrame, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """``(size_label, basket_id, items)``: for each label an independent
    Bernoulli sample at its fraction (md5 of seed, label and basket id).

    The (label, fraction) list is a short parameter inlined as a literal
    array, so no join is needed.
    """
    specs = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(float(v)).alias("fraction"))
                      for k, v in fractions.items()])
    x = baskets.select("basket_id", "items", F.explode(specs).alias("s"))
    u = md5_unit(seed, F.concat(F.col("s.label"), F.lit(":"), F.col("basket_id").cast("string")))
    return (x.where(u < F.col("s.fraction") * F.lit(float(TWO_32)))
             .select(F.col("s.label").alias("size_label"), "basket_id", "items"))


def write_size_variants(variants: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S6 sink: one folder per size label."""
    variants.write.mode(mode).partitionBy("size_label").parquet(path)
