"""Itemset lattice: nodes and edges (J5, M9), reachability (M10), level
tables (A12, A13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import drop_each
from basketry.operators.candidates import _containment_pairs
from basketry.session import cut


def distinct_itemsets(itemsets: DataFrame) -> DataFrame:
    """One row per itemset (max support: deterministic, unlike
    ``dropDuplicates``)."""
    return itemsets.groupBy("items").agg(F.max("support").alias("support"))


def level_union(levels: list[DataFrame]) -> DataFrame:
    """All levels in one table with a 1-based ``level`` column."""
    out = None
    for i, d in enumerate(levels, start=1):
        x = d.select("items", "support", F.lit(i).alias("level"))
        out = x if out is None else out.unionByName(x)
    return out


def level(nodes: DataFrame, i: int) -> DataFrame:
    """The nodes of one level; an out-of-range level raises."""
    top = nodes.agg(F.max("level")).first()[0]
    if top is None or i < 1 or i > top:
        raise IndexError(f"illegal level {i}")
    return nodes.where(F.col("level") == F.lit(i))


def lattice_edges(nodes: DataFrame, relation: str = "immediate") -> DataFrame:
    """``(parent, child)`` edges.

    ``immediate``: parent = child minus one item (an equi join; the right
    relation for a complete frequent table). ``cover``: parent strictly
    contained in child with no node in between (closed families, where sizes
    can jump).
    """
    items = nodes.select("items").distinct()
    if relation == "immediate":
        subs = items.select(F.col("items").alias("child"), F.explode(drop_each("items")).alias("parent"))
        subs = subs.where(F.size("parent") > 0)
        return subs.join(items.select(F.col("items").alias("parent")), "parent", "left_semi") \
                   .select("parent", "child").distinct()
    if relation != "cover":
        raise ValueError(relation)
    return _covers(items)


def _strict_supersets(items: DataFrame, n_items: int) -> DataFrame:
    return _containment_pairs(items.select(F.col("items").alias("sub")),
                              items.select(F.col("items").alias("sup")), n_items, strict=True)


def _covers(items: DataFrame) -> DataFrame:
    """Covers by closures within the family: the closure of X + e is the smallest node
    that holds X + e, and Y covers X when that is Y for all |Y| - |X| items e of Y outside X.

    Containments stream into one aggregate with a row per (X, e); neither pairs
    of nodes nor pairs of pairs are stored or joined. Smallest nodes are unique in a family
    closed under intersection, as closed sets are. The aggregate also counts the nodes
    above X + e; should these be others than those above its closure, the family is
    not of this kind, and the covers are found by removing two-step chains.
    """
    n_items = items.count()
    none = F.lit(None).cast(items.schema["items"].dataType.elementType)
    above = _strict_supersets(items, n_items)
    # the row without an item counts the nodes above X itself
    each = above.select("sub", "sup", F.explode_outer(F.concat(F.array_except("sup", "sub"), F.array(none))).alias("e"))
    jumps = cut(each.groupBy("sub", "e").agg(F.min(F.struct(F.size("sup").alias("size"), "sup"))["sup"].alias("child"),
                                             F.count(F.lit(1)).alias("holders")))
    over = jumps.where(F.col("e").isNull()).select(F.col("sub").alias("child"), F.col("holders").alias("over"))
    unique = F.col("holders") == F.coalesce("over", F.lit(0)) + 1
    steps = cut(jumps.where(F.col("e").isNotNull()).join(over, "child", "left").groupBy("sub", "child")
                .agg(F.count(F.lit(1)).alias("k"), F.min(unique).alias("unique")))
    if not steps.where(~F.col("unique")).limit(1).count():
        covers = steps.where(F.col("k") == F.size("child") - F.size("sub"))
        return covers.select(F.col("sub").alias("parent"), "child")
    pairs = cut(above.select(F.col("sub").alias("parent"), F.col("sup").alias("child")))
    two = (pairs.select("parent", F.col("child").alias("mid"))
                .join(pairs.select(F.col("parent").alias("mid"), "child"), "mid")
                .select("parent", "child").distinct())
    return pairs.join(two, ["parent", "child"], "left_anti")


def itemset_lattice(itemsets: DataFrame, relation: str = "immediate") -> tuple[DataFrame, DataFrame]:
    """M9: ``nodes(items, support, level = size)`` and ``edges(parent, child)``.
    Children without a parent stay nodes but get no edge."""
    nodes = distinct_itemsets(itemsets).withColumn("level", F.size("items"))
    return nodes, lattice_edges(nodes, relation)


def reachable_itemsets(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None,
                       max_depth: int | None = None) -> DataFrame:
    """Breadth-first from ``roots`` (default: the lowest level) over the
    edges; each itemset once, with its depth. A frontier join per step, each
    frontier checkpointed."""
    if roots is None:
        low = nodes.agg(F.min("level")).first()[0]
        roots = nodes.where(F.col("level") == F.lit(low))
    frontier = cut(roots.select("items").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    depth = 0
    n_front = frontier.count()
    while n_front > 0 and (max_depth is None or depth < max_depth):
        depth += 1
        nxt = (frontier.join(edges.withColumnRenamed("parent", "items"), "items")
                       .select(F.col("child").alias("items")).distinct()
                       .join(seen.select("items"), "items", "left_anti")
                       .withColumn("depth", F.lit(depth)))
        frontier = cut(nxt)
        n_front = frontier.count()
        if n_front:
            seen = seen.unionByName(frontier)
    return seen
