"""Candidate generation and itemset-table joins.

All joins here are equi joins on an array key (arrays are valid join and
grouping keys), except containment: the cover lattice and A10 use the anchor-item
equi join of ``support.match_codes`` on the raw items, J8 set tries in bounded groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import contains_all, drop_each
from basketry.operators.encoding import maybe_broadcast
from basketry.session import cut

# J3 carries the common items in rows of about this many.
ITEMS_PER_ROW = 1_000

# J8 aims at groups of about this many rows on either side.
GROUP_ROWS = 20_000


def expand_level(level: DataFrame, common: DataFrame, drop_seen: bool = False) -> DataFrame:
    """Every X of ``level`` and common item e not in X give X + {e}, distinct.

    The result is this product by definition, whatever the number of common
    items: these are gathered in rows of about ``ITEMS_PER_ROW``, and each set
    meets each row once. ``drop_seen`` drops results already in the level (the fastExpand form).
    The miners do not use this full product: they extend only by items that
    co-occur often enough (``closure_codes``'s ``ext``).
    """
    listed = common.select("item").distinct()
    rows = max(1, -(-listed.count() // ITEMS_PER_ROW))
    gathered = (listed.groupBy(F.pmod(F.xxhash64("item"), F.lit(rows)).alias("row"))
                      .agg(F.collect_list("item").alias("common")).drop("row"))
    # a row holds up to a thousand items, so even few rows are measured; Spark's
    # product of two large sides is partitioned on both
    out = (level.select("items").crossJoin(maybe_broadcast(gathered, rows, wide=True))
                .select("items", F.explode(F.array_except("common", "items")).alias("e"))
                .select(F.sort_array(F.array_union("items", F.array("e"))).alias("items"))
                .distinct())
    if drop_seen:
        out = out.join(level.select("items"), "items", "left_anti")
    return out


def prefix_join(level: DataFrame) -> DataFrame:
    """Join two (k-1)-sets that share their first k-2 items -> k-set.

    ``level`` holds sorted (k-1)-itemsets of one size. Equi join on the prefix
    (no subset pruning, as in the reference's candidate step).
    """
    a = level.select(F.col("items").alias("a"))
    a = a.select("a", F.slice("a", 1, F.size("a") - 1).alias("prefix"),
                 F.element_at("a", -1).alias("a_last"))
    b = a.select(F.col("prefix"), F.col("a_last").alias("b_last"))
    j = a.join(b, "prefix").where(F.col("a_last") < F.col("b_last"))
    return j.select(F.concat("a", F.array("b_last")).alias("items")).distinct()


def closed_only(frequent: DataFrame) -> DataFrame:
    """Drop X when an immediate superset has the same support.

    Needs a complete (downward closed) frequent table. Each (k+1)-set emits
    its k-subsets with its support; a left-anti equi join on
    (items, support) removes the non-closed ones.
    """
    sub = (frequent.where(F.size("items") >= 2)
                   .select(F.explode(drop_each("items")).alias("items"), "support")
                   .distinct())
    return frequent.join(sub, ["items", "support"], "left_anti")


def closed_only_any(itemsets: DataFrame) -> DataFrame:
    """J6 for any list of itemsets: drop X when a strict superset in the list
    has the same support. An anti join on (support, X's rarest item)."""
    sets = itemsets.select("items", "support").distinct()
    sups = sets.select(F.col("items").alias("sup"), "support")
    sub = rarest_anchor(itemsets.withColumnRenamed("items", "sub"), sups)
    probe = sups.select("sup", "support", F.explode("sup").alias("anchor"))
    same = (sub["support"] == probe["support"]) & (sub["anchor"] == probe["anchor"])
    larger = (F.size("sup") > F.size("sub")) & contains_all("sup", "sub")
    kept = sub.join(probe, same & larger, "left_anti")
    return kept.drop("anchor").withColumnRenamed("sub", "items")


def rarest_anchor(small: DataFrame, big: DataFrame) -> DataFrame:
    """``small`` with the ``anchor`` of each ``sub``: its item that the fewest
    ``sup`` of ``big`` hold (a set with an item that none holds gets that item)."""
    held = big.select(F.explode("sup").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("_held"))
    named = (small.select("sub").distinct().select("sub", F.explode("sub").alias("anchor"))
             .join(held, "anchor", "left")
             .groupBy("sub").agg(F.min_by("anchor", F.struct(F.coalesce("_held", F.lit(0)), "anchor")).alias("anchor")))
    return small.join(named, "sub")


def itemset_difference(x: DataFrame, y: DataFrame, col: str = "items") -> DataFrame:
    """Rows of x whose itemset is not in y (x's duplicates kept)."""
    return x.join(y.select(col).distinct(), col, "left_anti")


def _containment_pairs(small: DataFrame, big: DataFrame, small_rows: int,
                       strict: bool = False) -> DataFrame:
    """Pairs (sub, sup) with sub contained in sup, for two itemset tables with
    columns ``sub`` and ``sup`` (+ extra columns). Anchor on sub's rarest item."""
    s = maybe_broadcast(rarest_anchor(small, big), small_rows)
    probe = big.select("*", F.explode("sup").alias("anchor"))
    cond = contains_all("sup", "sub")
    if strict:
        cond = cond & (F.size("sup") > F.size("sub"))
    return probe.join(s, "anchor").where(cond).drop("anchor")


def _bounds_worker(kind):
    """Worker function of ``support_upper_bound`` for one group of both sides, with itemsets
    of the Arrow type ``kind`` (shipped by value, so workers need not have this package)."""
    import pyarrow as pa

    def branch():
        return [None, {}, None]   # support of the set that ends here, branches, least support below

    def least_subset(known, itemsets):
        """For each itemset the least support of a known subset of it. Known sets stand
        in a trie of their sorted items; branches that cannot improve are not entered."""
        root = branch()
        for items, support in known:
            path = [root]
            for item in items:
                path.append(path[-1][1].setdefault(item, branch()))
            for node in path:
                node[2] = support if node[2] is None else min(node[2], support)
            path[-1][0] = support if path[-1][0] is None else min(path[-1][0], support)
        for items in itemsets:
            best, todo = None, [(root, 0)]
            while todo:
                (own, branches, below), at = todo.pop()
                if below is None or best is not None and below >= best:
                    continue
                if own is not None and (best is None or own < best):
                    best = own
                todo += [(branches[item], k + 1) for k, item in enumerate(items[at:], at) if item in branches]
            yield best

    def run(known, itemsets):
        sets = [sorted(x) for x in itemsets.column("sup").to_pylist()]
        subsets = [(sorted(x), s) for x, s in zip(known.column("sub").to_pylist(), known.column("ksup").to_pylist())]
        bounds = list(least_subset(subsets, sets))
        found = pa.array([k for k, b in enumerate(bounds) if b is not None], pa.int64())
        return pa.table({"sup": itemsets.column("sup").take(found).cast(kind),
                         "bound": pa.array([b for b in bounds if b is not None], pa.int64())})

    return run


def support_upper_bound(itemsets: DataFrame, known: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For each itemset, the minimum support among ``known`` itemsets that
    are subsets of it (null when none is).

    Known sets are dealt by their rarest item to about rows / ``group_rows`` buckets, and each itemset
    to the buckets of its items. A bucket with more rows on either side is
    dealt on by a hash, every part of one side meeting every part of the other, so a group
    stays near ``group_rows`` rows a side whatever the item. In a group the known sets are a
    set trie; each itemset leaves with its least support alone, and no
    containment pair is listed.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    k = cut(known.where(F.size("items") > 0).groupBy(F.col("items").alias("sub")).agg(F.min("support").cast("long").alias("ksup")))
    h = cut(itemsets.select(F.col("items").alias("sup")).distinct())
    buckets = max(1, -(-k.count() // group_rows))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    k = rarest_anchor(k, h).select("sub", "ksup", bucket("anchor").alias("bucket"))
    h = h.select("sup", F.explode(F.array_distinct(F.transform("sup", bucket))).alias("bucket"))
    parts = F.ceil(F.count(F.lit(1)) / group_rows).cast("int")
    sizes = (k.groupBy("bucket").agg(parts.alias("k_parts"))
             .join(h.groupBy("bucket").agg(parts.alias("h_parts")), "bucket"))
    sizes = maybe_broadcast(cut(sizes), buckets)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c, n: F.pmod(F.hash(c, F.lit(7)), F.col(n))
    k = k.join(sizes, "bucket").select("bucket", own("sub", "k_parts").alias("k_part"), every("h_parts").alias("h_part"), "sub", "ksup")
    h = h.join(sizes, "bucket").select("bucket", own("sup", "h_parts").alias("h_part"), every("k_parts").alias("k_part"), "sup")
    keys = ["bucket", "k_part", "h_part"]
    kind = h.schema["sup"].dataType.simpleString()
    worker = _bounds_worker(pa.list_(to_arrow_type(h.schema["sup"].dataType.elementType)))
    met = k.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInArrow(worker, f"sup {kind}, bound long")
    bound = met.groupBy("sup").agg(F.min("bound").alias("bound"))
    return itemsets.join(bound.withColumnRenamed("sup", "items"), "items", "left")


def expand_subsets(itemsets: DataFrame, include_self: bool = True, smallest: int = 1) -> DataFrame:
    """Every non-empty proper subset with its superset's support; with
    the sets themselves and max(support) per subset, closed -> all frequent.

    Level by level from the largest size down: each set gives its one-item
    smaller subsets, the largest support of each is kept, and the level is
    written. A set of any size is expanded completely, down to subsets of
    ``smallest`` items (a set of k items has 2^k - 1 non-empty ones).
    """
    given = itemsets.select("items", "support", F.lit(True).alias("own"))
    top = given.agg(F.max(F.size("items"))).first()[0] or 0
    above, out = None, None
    for size in range(top, smallest - 1, -1):
        level = given.where(F.size("items") == size)
        if above is not None:
            below = above.select(F.explode(drop_each("items")).alias("items"), "support", F.lit(False).alias("own"))
            level = level.unionByName(below)
        # "own": not a proper subset of another set
        above = cut(level.groupBy("items").agg(F.max("support").alias("support"), F.min("own").alias("own")))
        out = above if out is None else out.unionByName(above)
    if out is None:
        return itemsets.select("items", "support").limit(0)
    return (out if include_self else out.where(~F.col("own"))).select("items", "support")
