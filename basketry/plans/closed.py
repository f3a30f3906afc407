"""Closed itemset miners: closure jump (M1), naive (M3), FP-growth + filter (M5).

All three must return the same ``(items, support)`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import min_count_for
from basketry.operators.candidates import closed_only
from basketry.operators.encoding import Encoded, decode, encode, maybe_broadcast
from basketry.operators import support
from basketry.session import cut


def resolve_min_count(n: int, min_count: int | None, min_ratio: float | None) -> int:
    if (min_count is None) == (min_ratio is None):
        raise ValueError("give exactly one of min_count / min_ratio")
    return int(min_count) if min_count is not None else min_count_for(min_ratio, n)


@dataclass
class ClosedLevels:
    """The closed sets found by the closure jump, in codes."""
    sets: DataFrame              # closure, support, level
    edges: DataFrame | None      # parent, child: the covers among them, when asked for


def closed_levels(enc: Encoded, min_count: int, allowed_codes: DataFrame | None = None,
                  strategy: str = "auto", max_levels: int | None = None, with_edges: bool = False) -> ClosedLevels:
    """The closure-jump loop on coded baskets.

    Level 1 candidates are the frequent (allowed) items. Per level: one
    containment match + co-count gives each candidate's support, closure and
    frequent extensions; distinct closures not seen before form the level;
    each is extended by one frequent co-occurring item for the next level.
    A closed set reached by two routes is kept (and expanded) once.
    Only three numbers per level (its rows, its extensions and their bytes) reach the
    driver; every level is checkpointed to the shared folder, so the lineage
    stays one level deep.

    ``allowed_codes`` (column ``code``) restricts seeds and extensions and
    drops closures holding any other item (the sampled miner's common items).

    ``with_edges``: closed Y covers closed X when every item of Y outside X
    jumps from X to Y, that is when closure(X + e) = Y for all |Y| - |X| of
    them. The loop computes these closures anyway, so edges cost one equi join per level
    of (X, e) with the candidates' closures, and no two closed sets are compared.
    """
    spark = enc.baskets.sparkSession
    if allowed_codes is not None:
        allowed = cut(allowed_codes.select("code").distinct())
        n_allowed = allowed.count()
        cands = allowed.select(F.array("code").alias("cand"))
        n_c = n_allowed
    else:
        allowed = None
        cands = enc.codes.select(F.array("code").alias("cand"))
        n_c = enc.n_codes
    one_chunk = enc.n_codes <= support.CODES_PER_ROW
    seen, steps, n_bytes = None, None, 32 * n_c
    levels, edges = [], []
    lvl_no = 1
    while n_c > 0 and (max_levels is None or lvl_no <= max_levels):
        parts = support.closure_parts(enc, cands, n_c, ext_min=min_count, strategy=strategy, cand_bytes=n_bytes)
        parts = parts.where(F.col("support") >= F.lit(min_count))
        if with_edges or not one_chunk:
            parts = cut(parts)
        sc = parts if one_chunk else support.whole_closures(enc, parts)
        if steps is not None:
            jumps = steps.join(sc.select("cand", "closure"), "cand").groupBy("parent", "closure")
            covers = jumps.agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == F.size("closure") - F.size("parent"))
            edges.append(cut(covers.select("parent", F.col("closure").alias("child"))))
        if allowed is not None:
            # drop closures holding an item outside the allowed (bounded) set
            bad = (sc.select("cand", F.explode("closure").alias("code"))
                     .join(maybe_broadcast(allowed, n_allowed), "code", "left_anti")
                     .select("cand").distinct())
            sc = sc.join(bad, "cand", "left_anti")
        if one_chunk:
            lvl = sc.groupBy("closure").agg(F.first("support").alias("support"), F.first("ext").alias("ext"))
        else:
            lvl = sc.groupBy("closure").agg(F.first("support").alias("support"), F.min("cand").alias("cand"))
        if seen is not None:
            lvl = lvl.join(seen, "closure", "left_anti")
        if not one_chunk:
            # a row per closure and chunk of extensions, at least one
            more = parts.where(F.size("ext") > 0).select("cand", "ext")
            lvl = lvl.join(more, "cand", "left").drop("cand")
        lvl = cut(lvl.withColumn("level", F.lit(lvl_no)))
        more = F.coalesce(F.size("ext"), F.lit(0))
        stats = lvl.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum(more), F.lit(0)).alias("e"),
                        F.coalesce(F.sum(more * (F.size("closure") + 4) * 8), F.lit(0)).alias("bytes")).first()
        if stats["k"] == 0:
            break
        own = lvl.select("closure", "support", "level")
        levels.append(own if one_chunk else own.distinct())
        found = levels[-1].select("closure")
        seen = found if seen is None else seen.unionByName(found)
        ext = lvl.select("closure", F.explode("ext").alias("e"))
        if allowed is not None:
            ext = ext.join(maybe_broadcast(allowed.withColumnRenamed("code", "e"), n_allowed),
                           "e", "left_semi")
        # next candidates stay lazy: their rows and bytes are bounded by those of
        # the extensions, which decide the broadcast and end the loop
        steps = ext.select(F.col("closure").alias("parent"),
                           F.sort_array(F.array_union("closure", F.array("e"))).alias("cand"))
        cands = steps.select("cand").distinct()
        steps = steps if with_edges else None
        n_c, n_bytes = stats["e"], stats["bytes"]
        lvl_no += 1

    def union(tables: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], schema)

    return ClosedLevels(union(levels, "closure array<long>, support long, level int"),
                        union(edges, "parent array<long>, child array<long>") if with_edges else None)


def closed_itemsets(baskets: DataFrame, min_count: int | None = None,
                    min_ratio: float | None = None, strategy: str = "auto",
                    with_level: bool = False, n: int | None = None) -> DataFrame:
    """M1: frequent closed itemsets ``(items, support)`` by closure jumps."""
    if (min_count is None) == (min_ratio is None):
        raise ValueError("give exactly one of min_count / min_ratio")
    enc = encode(baskets, min_count, order="support", n=n, min_ratio=min_ratio)
    res = closed_levels(enc, enc.min_count, strategy=strategy).sets
    out = decode(res, enc.codes, enc.n_codes, "closure", "items")
    cols = ["items", "support"] + (["level"] if with_level else [])
    return out.select(*cols)


def closed_lattice(baskets: DataFrame, min_count: int | None = None, min_ratio: float | None = None,
                   strategy: str = "auto", n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """M9 from the baskets: ``nodes(items, support, level = size)`` of all frequent closed
    sets and ``edges(parent, child)``, their covers, both from one closure-jump run."""
    if (min_count is None) == (min_ratio is None):
        raise ValueError("give exactly one of min_count / min_ratio")
    enc = encode(baskets, min_count, order="support", n=n, min_ratio=min_ratio)
    res = closed_levels(enc, enc.min_count, strategy=strategy, with_edges=True)
    nodes = cut(decode(res.sets.select("closure", "support"), enc.codes, enc.n_codes, "closure", "items"))
    edges = decode(decode(res.edges, enc.codes, enc.n_codes, "parent", "parent"), enc.codes, enc.n_codes, "child", "child")
    return nodes.select("items", "support", F.size("items").alias("level")), edges.select("parent", "child")


def closed_itemsets_naive(baskets: DataFrame, min_count: int | None = None,
                          min_ratio: float | None = None, strategy: str = "auto",
                          n: int | None = None) -> DataFrame:
    """M3: every frequent itemset (level-wise Apriori counting), then the
    closure of each by co-count; the distinct closures are the answer."""
    from basketry.plans.frequent import apriori_codes
    if (min_count is None) == (min_ratio is None):
        raise ValueError("give exactly one of min_count / min_ratio")
    # rarest-first codes: the first code of a candidate is its anchor
    enc = encode(baskets, min_count, order="support", n=n, min_ratio=min_ratio)
    freq = apriori_codes(enc, enc.min_count, strategy=strategy, frequent_only=True)
    freq = cut(freq.select("cand"))
    n_f = freq.count()
    cl = support.closure_codes(enc, freq, n_f, strategy=strategy)
    closed = cl.groupBy("closure").agg(F.max("support").alias("support"))
    return decode(closed, enc.codes, enc.n_codes, "closure", "items").select("items", "support")


def closed_itemsets_fp(baskets: DataFrame, min_count: int | None = None,
                       min_ratio: float | None = None, num_partitions: int | None = None,
                       n: int | None = None) -> DataFrame:
    """M5: ML FP-growth (all frequent itemsets), then the closed filter J6."""
    from basketry.plans.frequent import frequent_itemsets_fp
    freq = frequent_itemsets_fp(baskets, min_count=min_count, min_ratio=min_ratio,
                                num_partitions=num_partitions, n=n)
    return closed_only(freq.select("items", "support"))
