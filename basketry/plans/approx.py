"""The sampled closed-itemset miner (M2) and its sample statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import explode_items, in_sample
from basketry.operators.encoding import encode, decode, maybe_broadcast
from basketry.operators.sampling import ALPHA_IN_USE, sample_fraction
from basketry.operators.support import itemset_support
from basketry.plans.closed import closed_levels
from basketry.session import cut

# Fixed value: the three sample seeds (md5 buckets, reproducible in SQL).
SAMPLE_SEEDS = (42, 43, 44)


def tagged_samples(baskets: DataFrame, fraction: float, seeds=SAMPLE_SEEDS) -> DataFrame:
    """``baskets`` that fall in a sample, with ``samples``, the numbers of those
    they fall in: one scan for all samples."""
    tags = F.filter(F.array(*[F.when(in_sample(s, F.col("basket_id"), fraction), F.lit(i))
                              for i, s in enumerate(seeds)]), lambda x: x.isNotNull())
    return baskets.select("basket_id", "items", tags.alias("samples")).where(F.size("samples") > 0)


def _sample_counts(tagged: DataFrame) -> DataFrame:
    x = tagged.select(F.explode("samples").alias("sample"), "items")
    x = explode_items(x, "items", "item", "sample")
    return x.groupBy("sample", "item").agg(F.count(F.lit(1)).alias("support"))


def per_sample_item_counts(baskets: DataFrame, fraction: float,
                           seeds=SAMPLE_SEEDS) -> DataFrame:
    """``(sample, item, support)`` for every seed's sample, in one scan: each
    basket is tagged with the samples it falls in, then one grouped count."""
    return _sample_counts(tagged_samples(baskets, fraction, seeds))


def _voted(counts: DataFrame, threshold: float, votes: int) -> DataFrame:
    c = counts.where(F.col("support") >= F.lit(float(threshold)))
    return (c.groupBy("item").agg(F.countDistinct("sample").alias("votes"))
             .where(F.col("votes") >= F.lit(votes)))


def majority_items(baskets: DataFrame, fraction: float, threshold: float, votes: int = 2,
                   seeds=SAMPLE_SEEDS) -> DataFrame:
    """Items whose count reaches ``threshold`` (the scaled threshold) in at
    least ``votes`` of the samples."""
    return _voted(per_sample_item_counts(baskets, fraction, seeds), threshold, votes)


def mean_item_support(baskets: DataFrame, fraction: float, seeds=SAMPLE_SEEDS) -> DataFrame:
    """Mean of an item's counts over the samples in which it occurs."""
    c = per_sample_item_counts(baskets, fraction, seeds)
    return c.groupBy("item").agg(F.avg("support").alias("mean_support"),
                                 F.count(F.lit(1)).alias("n_samples"))


def approx_closed_itemsets(baskets: DataFrame, threshold: int, eps: float,
                           alpha: float = ALPHA_IN_USE, seeds=SAMPLE_SEEDS,
                           n: int | None = None, strategy: str = "auto") -> DataFrame:
    """M2: find closed itemsets on a sample, count them exactly on all data.

    Sample size from P2(a) (fraction clamped to 1, threshold scaled by it);
    seed items = majority vote over three samples (A8); closure-jump loop on
    sample 1 at the scaled threshold, closures restricted to the common items;
    then one exact support count of the distinct result on the full baskets,
    with no re-filter. Returns ``(items, support, meets_threshold)``.

    The baskets are read three times at most: to count them (where ``n`` is not
    given), to write the tagged samples, from which all mining starts, and to recount.
    """
    if n is None:
        n = baskets.count()
    _, frac = sample_fraction(n, threshold, eps, alpha)
    scaled = float(threshold) * frac
    smc = max(1, int(math.ceil(scaled - 1e-9)))
    tagged = cut(tagged_samples(baskets, frac, seeds))
    common = cut(_voted(_sample_counts(tagged), scaled, 2).select("item"))
    enc = encode(tagged.where(F.array_contains("samples", 0)), smc, order="support", n=-1)
    allowed = enc.codes.join(maybe_broadcast(common, common.count()), "item", "left_semi")
    found = closed_levels(enc, smc, allowed_codes=allowed.select("code"), strategy=strategy).sets
    found = cut(decode(found.select("closure"), enc.codes, enc.n_codes, "closure", "items"))
    exact = cut(itemset_support(baskets, found, strategy=strategy))
    return exact.select("items", "support",
                        (F.col("support") >= F.lit(int(threshold))).alias("meets_threshold"))
