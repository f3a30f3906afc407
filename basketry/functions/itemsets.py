"""Column expressions over itemsets (``array<T>`` columns).

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen; nothing runs in Python per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def canonical(col) -> Column:
    """canonical form of an itemset (distinct, sorted)."""
    return F.sort_array(F.array_distinct(_c(col)))


def itemset_key(col, sep: str = "|") -> Column:
    """printable key of a canonical itemset, e.g. ``a|b|c``."""
    return F.array_join(F.transform(_c(col), lambda x: x.cast("string")), sep)


def explode_items(df, col: str = "items", alias: str = "item", *keep):
    """One row per element of ``col`` (plus the ``keep`` columns).

    ``explode`` makes Catalyst infer ``size(col) > 0`` and push it below
    projections and repartitions, which evaluates an expensive basket
    expression (split, lower, distinct, sort) a second time in the scan
    stage. ``explode_outer`` + a null filter on the generated column keeps
    the same rows (items are never null) without that duplicate work.
    """
    return (df.select(*keep, F.explode_outer(col).alias(alias))
              .where(F.col(alias).isNotNull()))


def contains_all(container, subset) -> Column:
    """``subset`` is contained in ``container`` (both arrays)."""
    return F.size(F.array_except(_c(subset), _c(container))) == 0


def min_count_for(ratio: float, n: int) -> int:
    """Relative threshold -> absolute count: ceil(ratio * n), never below 1.

    One helper for all miners, so ratio and count thresholds agree; the small
    epsilon keeps 0.7 * 10 at 7 despite float error.
    """
    return max(1, int(math.ceil(ratio * n - 1e-9)))


def md5_unit(seed, key) -> Column:
    """Deterministic 32-bit bucket of ``key`` for ``seed`` in [0, 2^32).

    Same value as DuckDB ``cast('0x'||substr(md5(seed||':'||key),1,8) as bigint)``,
    so a sample is reproducible by SQL and stable under repartitioning.
    """
    s = F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def in_sample(seed, key, fraction: float) -> Column:
    return md5_unit(seed, key) < F.lit(float(fraction) * TWO_32)


def drop_each(col) -> Column:
    """The immediate subsets of an itemset: one per left-out position."""
    c = _c(col)
    return F.transform(F.sequence(F.lit(0), F.size(c) - 1),
                       lambda i: F.filter(c, lambda x, j: j != i))
