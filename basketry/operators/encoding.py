"""Item counting (A1, A2) and the integer item codes every miner works on.

Miners do not carry the raw items through their joins. After one item count
they give each *relevant* item (frequent, or named by a candidate) a dense
``int`` code, rewrite every basket as the sorted array of its codes, and fold
identical baskets into one row with a ``weight``. Supports then become
``sum(weight)``.

Size bound for the code table: an item with support >= m occupies m basket
slots, so at most ``sum(|basket|) / m`` items are frequent. That bound does
not grow with the number of baskets for a fixed relative threshold, which is
why the code table may be broadcast (the row count is still checked against
``BROADCAST_ROWS`` before every broadcast).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from basketry.functions.itemsets import explode_items
from basketry.session import cut, persisted

# Largest side we broadcast, in rows and in bytes; above it the join shuffles.
# Both plans give the same rows.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
# Tables of so few rows are not measured.
UNMEASURED_ROWS = 1_000


def table_bytes(df: DataFrame) -> int:
    """The size of a table's rows as text, an upper bound of the order of what a broadcast holds."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long"))).first()[0] or 0


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS, wide: bool = False) -> DataFrame:
    """``df`` marked for broadcast if its rows (``rows``, at least as many as it has) and bytes
    are within the limits. ``wide``: rows of unbounded width, measured however few."""
    if rows > limit:
        return df
    if (wide or rows > UNMEASURED_ROWS) and table_bytes(df) > BROADCAST_BYTES:
        return df
    return F.broadcast(df)


def item_support(baskets: DataFrame, min_count: int | None = None) -> DataFrame:
    """A1: support per item, optionally only those with support >= min_count.

    explode + groupBy: partial aggregation before the shuffle, so a hot item
    costs one row per task on the wire.
    """
    out = (explode_items(baskets.select(F.array_distinct("items").alias("items")))
           .groupBy("item").agg(F.count(F.lit(1)).alias("support")))
    if min_count is not None:
        out = out.where(F.col("support") >= F.lit(int(min_count)))
    return out


def counted_items(baskets: DataFrame) -> DataFrame:
    """``(item, support)`` of every item, and the number of baskets as the support of
    the null item: one pass and one aggregate for both."""
    none = F.lit(None).cast(baskets.schema["items"].dataType.elementType)
    marked = F.concat(F.coalesce(F.array_compact(F.array_distinct("items")), F.array().cast(baskets.schema["items"].dataType)),
                      F.array(none))
    return (baskets.select(F.explode_outer(marked).alias("item"))
                   .groupBy("item").agg(F.count(F.lit(1)).alias("support")))


def distinct_items(baskets: DataFrame) -> DataFrame:
    """A2: the item universe (sort it with ``orderBy('item')`` if needed)."""
    return explode_items(baskets).distinct()


def item_codes(supports: DataFrame, order: str = "support") -> DataFrame:
    """Dense ``long`` codes 0..F-1 for an item table ``(item, support)``,
    increasing in rank order.

    ``order='support'`` ranks rarest first, so the first code of a sorted
    itemset is its rarest item; ``order='item'`` keeps the natural order (used
    where the candidate set depends on it, Apriori). The table is range-sorted
    across the cluster and written once; a row's place in its partition plus
    the sizes of the partitions before it is its code. Only one count per
    partition reaches the driver.
    """
    keys = [F.col("support"), F.col("item")] if order == "support" else [F.col("item")]
    placed = cut(supports.orderBy(*keys).select("item", "support", F.monotonically_increasing_id().alias("place")))
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k")).collect())
    starts, start = [], 0
    for r in sizes:
        starts += [F.lit(r["part"]), F.lit(start)]
        start += r["k"]
    if not sizes:
        return placed.select("item", "support", F.col("place").alias("code"))
    first = F.element_at(F.create_map(*starts), part)
    return placed.select("item", "support", (first + place).cast("long").alias("code"))


@dataclass
class Encoded:
    """Baskets restricted to coded items: ``baskets(codes, weight)``."""
    codes: DataFrame      # item, support, code
    n_codes: int
    baskets: DataFrame    # codes array<long>, weight long
    n: int                # number of input baskets (including empty ones)
    min_count: int = 0
    counts: DataFrame | None = None   # item, support of every item (where one was written)


# Up to this many codes a basket is restricted by a native intersection with
# the coded items (no shuffle) before its few codes are looked up; above it
# an explode + join + regroup by a generated row key. Both plans take a basket's
# distinct items and every row as a basket of its own, whatever its id.
MAP_LOOKUP_MAX = 256


def encode_baskets(baskets: DataFrame, codes: DataFrame, n_codes: int,
                   keep_id: bool = False) -> DataFrame:
    """Rewrite baskets as sorted code arrays; drop items without a code.

    With ``keep_id=False`` identical code arrays are folded into one row with
    a weight (partial aggregation folds a hot duplicate basket map-side).

    Small code tables (checked count): a native hash ``array_intersect`` with
    the coded items restricts each basket inside the scan, identical
    restricted baskets fold first, and only then are the few distinct ones
    mapped to codes (the lookup lambda has no codegen, so it must not sit on
    top of the basket expression). Large tables: explode, broadcast join,
    regroup by a generated row key. Rows with the same id stay separate baskets,
    and an item repeated in a basket counts once, in both plans.
    """
    if n_codes <= MAP_LOOKUP_MAX:
        pairs = codes.select("item", "code").collect()
        keys = F.array(*[F.lit(r["item"]) for r in pairs])
        lookup = F.create_map(*[x for r in pairs for x in (F.lit(r["item"]), F.lit(r["code"]))])
        kept = F.array_intersect("items", keys)
        if keep_id:
            b = (baskets.select("basket_id", kept.alias("kept")).where(F.size("kept") > 0)
                        .withColumn("weight", F.lit(1).cast("long")))
        else:
            b = (baskets.select(kept.alias("kept")).where(F.size("kept") > 0)
                        .groupBy("kept").agg(F.count(F.lit(1)).alias("weight")))
        coded = F.sort_array(F.transform("kept", lambda x: F.element_at(lookup, x)))
        return b.withColumn("codes", coded).drop("kept")
    rows = baskets.select("basket_id", F.array_distinct("items").alias("items"),
                          F.monotonically_increasing_id().alias("_row"))
    x = explode_items(rows, "items", "item", "_row", *(["basket_id"] if keep_id else []))
    j = x.join(maybe_broadcast(codes.select("item", "code"), n_codes), "item")
    b = (j.groupBy("_row", *(["basket_id"] if keep_id else []))
          .agg(F.sort_array(F.collect_list("code")).alias("codes")).drop("_row"))
    if keep_id:
        return b.withColumn("weight", F.lit(1).cast("long"))
    return b.groupBy("codes").agg(F.count(F.lit(1)).alias("weight"))


def small_codes(sup: DataFrame, order: str):
    """Codes for a frequent-item table of at most ``MAP_LOOKUP_MAX`` rows,
    numbered on the driver from one bounded collect (no window job). Returns
    (None, 0) when the table is larger."""
    top = sup.select("item", "support").limit(MAP_LOOKUP_MAX + 1).collect()
    if len(top) > MAP_LOOKUP_MAX:
        return None, 0
    # UTF-8 byte order equals code-point order, so Python's sort agrees with Spark's
    key = (lambda r: (r["support"], r["item"])) if order == "support" else (lambda r: r["item"])
    rows = [(r["item"], int(r["support"]), i) for i, r in enumerate(sorted(top, key=key))]
    schema = StructType([StructField("item", sup.schema["item"].dataType),
                         StructField("support", LongType()), StructField("code", LongType())])
    return sup.sparkSession.createDataFrame(rows, schema), len(rows)


def encode(baskets: DataFrame, min_count: int | None = None, order: str = "support",
           n: int | None = None, min_ratio: float | None = None) -> Encoded:
    """Count, code the frequent items, encode and checkpoint the baskets.

    Two passes over the input: one counts baskets and items together, one encodes. A
    small input is kept for both (``persisted``), a large one read twice. What
    is written is the item table and the folded baskets of codes.
    """
    from basketry.functions.itemsets import min_count_for
    with persisted(baskets) as b:
        counts = counted_items(b)
        if n is None or order == "item":
            counts = cut(counts)
        if n is None:
            n = (counts.where(F.col("item").isNull()).first() or [None, 0])[1]
        mc = int(min_count) if min_count is not None else min_count_for(min_ratio, n)
        counts = counts.where(F.col("item").isNotNull())
        sup = counts.where(F.col("support") >= F.lit(mc))
        codes, n_codes = small_codes(sup, order)
        if codes is None:
            sup = cut(sup)
            codes = cut(item_codes(sup, order))
            n_codes = codes.count()
        enc = cut(encode_baskets(b, codes, n_codes))
    return Encoded(codes=codes, n_codes=n_codes, baskets=enc, n=n, min_count=mc, counts=counts)


def encode_itemsets(itemsets: DataFrame, codes: DataFrame, n_codes: int,
                    col: str = "items") -> DataFrame:
    """Distinct itemsets of ``col`` -> ``(col, cand)`` with ``cand`` the sorted
    code array. Itemsets with an item that has no code are dropped."""
    d = itemsets.select(col).distinct()
    x = d.select(col, F.explode(col).alias("item"))
    j = x.join(maybe_broadcast(codes.select("item", "code"), n_codes), "item")
    g = j.groupBy(col).agg(F.sort_array(F.collect_list("code")).alias("cand"))
    return g.where(F.size("cand") == F.size(col))


def decode(df: DataFrame, codes: DataFrame, n_codes: int, col: str = "cand",
           out: str = "items") -> DataFrame:
    """Replace the code array ``col`` by the sorted item array ``out``."""
    key = "_code_key"
    d = df.withColumnRenamed(col, key)
    x = d.select(key).distinct().select(key, F.explode(key).alias("code"))
    j = x.join(maybe_broadcast(codes.select("item", "code"), n_codes), "code")
    m = j.groupBy(key).agg(F.sort_array(F.collect_list("item")).alias(out))
    return d.join(m, key).drop(key)
