"""Projections and predicates over baskets and itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import contains_all, min_count_for
from basketry.functions.itemsets import explode_items as _explode
from basketry.operators.encoding import maybe_broadcast


def containing(baskets: DataFrame, itemset: list) -> DataFrame:
    """baskets that contain every item of ``itemset`` (a short literal)."""
    vals = sorted(set(itemset))
    if len(vals) == 1:
        return baskets.where(F.array_contains("items", vals[0]))
    lit = F.array(*[F.lit(v) for v in vals])
    # pre-filter on one item so the scan can skip most rows cheaply
    return baskets.where(F.array_contains("items", vals[0]) & contains_all("items", lit))


def min_support(itemsets: DataFrame, min_count: int | None = None, min_ratio: float | None = None,
                n: int | None = None, strict: bool = False, col: str = "support") -> DataFrame:
    """threshold on an absolute count (``>=``, or ``>`` with ``strict``) or
    on a ratio of ``n`` baskets (turned into a count by ``min_count_for``)."""
    if min_ratio is not None:
        if n is None:
            raise ValueError("min_ratio needs n")
        min_count = min_count_for(min_ratio, n)
    c = F.col(col)
    return itemsets.where(c > F.lit(min_count) if strict else c >= F.lit(min_count))


def only_common(itemsets: DataFrame, common: DataFrame) -> DataFrame:
    """keep itemsets all of whose items are in ``common`` (column ``item``)."""
    cm = common.select("item").distinct()
    n_c = cm.count()
    bad = (itemsets.select("items", F.explode("items").alias("item"))
                   .join(maybe_broadcast(cm, n_c), "item", "left_anti")
                   .select("items").distinct())
    return itemsets.join(bad, "items", "left_anti")


def explode_items(baskets: DataFrame) -> DataFrame:
    """one row per (basket, item)."""
    return _explode(baskets, "items", "item", "basket_id")


def scale_support(itemsets: DataFrame, factor: float, cap: int, col: str = "support") -> DataFrame:
    """``int(min(support * factor, cap))``."""
    scaled = F.floor(F.least(F.col(col) * F.lit(float(factor)), F.lit(float(cap)))).cast("long")
    return itemsets.withColumn(col, scaled)
