"""All-frequent-itemset miners: ML FP-growth (M4), Apriori (M6), SON (M7),
and the SON merge step (A11). All must return the same frequent rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import md5_unit
from basketry.operators.encoding import (Encoded, counted_items, decode, encode, encode_baskets, item_codes,
                                         maybe_broadcast, small_codes)
from basketry.operators.support import itemset_support, match_codes, rarest_code
from basketry.plans.closed import resolve_min_count
from basketry.session import cut, persisted


def frequent_itemsets_fp(baskets: DataFrame, min_count: int | None = None,
                         min_ratio: float | None = None, num_partitions: int | None = None,
                         n: int | None = None) -> DataFrame:
    """M4: ``pyspark.ml.fpm.FPGrowth`` -> ``(items, support, size)``.

    One aggregate counts baskets and items first: its histogram of the frequent items sets
    the number of groups (``fp_groups``) unless ``num_partitions`` does. The miner never sees the
    input's items: MLlib holds its baskets as objects and counts each of their items again, so it
    gets the codes of the frequent ones alone, one row for each basket that has any, kept in
    columns until it is done. FP-growth keeps itemsets with count >= ceil(minSupport * rows); passing
    ``(min_count - 0.5) / rows`` lands exactly on ``min_count`` with no float edge. Where the trees would
    hold more than ``TREE_PLACES`` places, the conditional bases are folded rows instead (``grown_codes``).
    """
    with persisted(baskets) as b:
        items = b.select("items")
        counts = cut(counted_items(items))
        if n is None:
            n = (counts.where(F.col("item").isNull()).first() or [None, 0])[1]
        mc = resolve_min_count(n, min_count, min_ratio)
        frequent = counts.where(F.col("item").isNotNull() & (F.col("support") >= F.lit(mc)))
        load = frequent.agg(
            F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("support"), F.lit(0)).alias("slots"),
            F.coalesce(F.max("support"), F.lit(0)).alias("most")).first()
        if not load["items"]:  # nothing is frequent (and FP-growth rejects minSupport > 1)
            return baskets.select(F.col("items"), F.lit(0).cast("long").alias("support"),
                                  F.lit(0).alias("size")).where(F.lit(False))
        codes, n_codes = small_codes(frequent, "support")
        if codes is None:
            codes, n_codes = cut(item_codes(frequent, "support")), load["items"]
        grown = not num_partitions and load["slots"] ** 2 > TREE_PLACES * max(n, 1)
        coded = encode_baskets(items.withColumn("basket_id", F.lit(0)), codes, n_codes, keep_id=not grown)
        if grown:
            coded = cut(coded)
        else:
            # filled here, so the input itself is not held any longer while the miner runs
            coded = coded.select("codes").persist(StorageLevel.MEMORY_AND_DISK)
            rows = coded.count()
    if grown:
        found = grown_codes(coded, codes, n_codes, mc)
    else:
        fp = FPGrowth(itemsCol="codes", minSupport=(mc - 0.5) / rows, minConfidence=0.0)
        groups = num_partitions or fp_groups(n_codes, load["slots"], load["most"],
                                             baskets.sparkSession.sparkContext.defaultParallelism)
        try:
            # the model's itemsets are a lazy RDD that re-mines on every action:
            # materialise them once in the shared checkpoint folder
            model = fp.setNumPartitions(int(groups)).fit(coded)
            found = cut(model.freqItemsets.select(F.sort_array("items").alias("cand"), F.col("freq").alias("support")))
        finally:
            coded.unpersist()
    return cut(decode(found, codes, n_codes).select("items", "support", F.size("items").alias("size")))


# MLlib's FP-growth gives each basket to the tree of every group of items: about half the
# square of its frequent items in places, built and sent as objects. Up to so many (at least the
# square of all baskets' places over the baskets) it mines; beyond, ``grown_codes`` does.
TREE_PLACES = 20_000_000


def grown_codes(enc: DataFrame, codes: DataFrame, n_codes: int, min_count: int) -> DataFrame:
    """Parallel FP-growth on folded baskets ``(codes, weight)`` -> ``(cand, support)``.

    The conditional base of a set is, as in FP-growth, what its baskets hold after the set's
    last code (rarest first). It is kept as rows (set, rest, weight), equal rests folded into one row, in
    place of a tree; a code that does not reach ``min_count`` in a base leaves it. A level gives
    all sets of one size: one fold of the bases, one count of their codes. Every aggregate combines map-side
    and no task or group holds a base whole.
    """
    kind = "smallint" if n_codes < 1 << 15 else "int"
    rows = enc.select(F.lit(0).cast("long").alias("set"), F.col("codes").cast(f"array<{kind}>").alias("rest"), "weight")
    sets = cut(codes.select(F.array(F.col("code").cast(kind)).alias("cand"), "support",
                            F.lit(0).cast("long").alias("parent"), F.col("code").cast(kind).alias("code"))
               .withColumn("set", F.monotonically_increasing_id()))
    n, out = n_codes, []
    while n:
        out.append(sets.select("cand", "support"))
        child = maybe_broadcast(sets.select(F.col("parent").alias("set"), "code", F.col("set").alias("child")), n)
        rows = cut(rows.select("set", "rest", "weight", F.posexplode("rest").alias("at", "code"))
                   .where(F.col("at") < F.size("rest") - 1).join(child, ["set", "code"])
                   .select(F.col("child").alias("set"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "weight")
                   .groupBy("set", "rest").agg(F.sum("weight").alias("weight")))
        held = (rows.select("set", "weight", F.explode("rest").alias("code"))
                .groupBy("set", "code").agg(F.sum("weight").alias("support")).where(F.col("support") >= F.lit(min_count)))
        sets = cut(held.join(maybe_broadcast(sets.select("set", "cand"), n), "set")
                   .select(F.concat("cand", F.array("code")).alias("cand"), "support", F.col("set").alias("parent"), "code")
                   .withColumn("set", F.monotonically_increasing_id()))
        n = sets.count()
        kept = sets.groupBy(F.col("parent").alias("set")).agg(F.collect_list("code").alias("kept"))
        rows = (rows.join(maybe_broadcast(kept, n, wide=True), "set")
                .select("set", F.array_intersect("rest", "kept").alias("rest"), "weight").where(F.size("rest") > 1))
    res = out[0]
    for d in out[1:]:
        res = res.unionByName(d)
    return res.select(F.col("cand").cast("array<bigint>").alias("cand"), "support")


def fp_groups(items: int, slots: int, most: int, parallelism: int, group_slots: int = 1_000_000) -> int:
    """Groups of the parallel FP-growth for ``items`` frequent items that fill ``slots`` basket
    places, the most frequent one ``most`` of them.

    A group's conditional baskets grow with the places of its items, so groups of about
    ``group_slots`` places keep a task's tree bounded; no group can be smaller than the
    most frequent item's, and there are at least as many as tasks run at once and
    no more than items.
    """
    wanted = -(-slots // max(group_slots, most, 1))
    return max(1, min(items, max(parallelism, wanted)))


def apriori_codes(enc: Encoded, min_count: int, strategy: str = "auto",
                  frequent_only: bool = False, max_level: int | None = None) -> DataFrame:
    """Level-wise Apriori on coded baskets (codes in natural item order).

    Level k counts the candidates of the reference's candidate step (two
    frequent (k-1)-sets sharing their first k-2 items) that occur at least
    once, without building the pairs: each basket holding a frequent
    (k-1)-set X adds the items e > last(X) it also holds, and a semi join
    keeps X + {e} when prefix(X) + {e} is frequent too.
    Returns ``(cand, level, support)`` for every counted candidate.
    """
    spark = enc.baskets.sparkSession
    lvl1 = cut(enc.codes.select(F.array("code").alias("cand"), F.lit(1).alias("level"),
                                F.col("support")))
    out = [lvl1]
    cur = lvl1.select("cand")
    n_cur = lvl1.count()
    k = 2
    while n_cur > 0 and (max_level is None or k <= max_level):
        anchored = rarest_code(cur, enc.codes, enc.n_codes)
        pairs = match_codes(enc.baskets, anchored, n_cur, strategy, n_codes=enc.n_codes)
        ext = pairs.select("cand", "weight",
                           F.explode(F.filter("codes", lambda c: c > F.element_at(F.col("cand"), -1)))
                           .alias("e"))
        if k > 2:
            other = cur.select(F.col("cand").alias("other"))
            ext = ext.withColumn("other", F.concat(F.slice("cand", 1, k - 2), F.array("e")))
            ext = ext.join(maybe_broadcast(other, n_cur), "other", "left_semi").drop("other")
        counted = (ext.groupBy(F.concat("cand", F.array("e")).alias("cand"))
                      .agg(F.sum("weight").alias("support"))
                      .withColumn("level", F.lit(k)))
        counted = cut(counted.select("cand", "level", "support"))
        out.append(counted)
        cur = counted.where(F.col("support") >= F.lit(min_count)).select("cand")
        n_cur = cur.count()
        k += 1
    res = out[0]
    for d in out[1:]:
        res = res.unionByName(d)
    if frequent_only:
        res = res.where(F.col("support") >= F.lit(min_count))
    return res


def frequent_itemsets_apriori(baskets: DataFrame, min_ratio: float = 0.5,
                              min_count: int | None = None, strategy: str = "auto",
                              n: int | None = None) -> DataFrame:
    """M6: the Apriori support table
    ``(items, level, support, rel_support, is_frequent)``: every counted
    candidate (support >= 1), infrequent ones included; level 1 is every item."""
    enc = encode(baskets, min_count, order="item", n=n, min_ratio=None if min_count is not None else min_ratio)
    singles = enc.counts.select(F.array("item").alias("items"), F.lit(1).alias("level"), "support")
    n, mc = enc.n, enc.min_count
    res = apriori_codes(enc, mc, strategy=strategy)
    res = decode(res.where(F.col("level") >= 2), enc.codes, enc.n_codes, "cand", "items")
    res = singles.unionByName(res.select("items", "level", "support"))
    return res.select("items", "level", "support",
                      (F.col("support") / F.lit(float(n))).alias("rel_support"),
                      (F.col("support") >= F.lit(mc)).alias("is_frequent"))


# --------------------------------------------------------------------------
# SON: local mining per chunk, then one exact global count
# --------------------------------------------------------------------------

# Bytes of baskets in a chunk, and baskets below which partitions are read together.
CHUNK_BYTES = 64 << 20
LEAST_CHUNK = 2_000


def _chunk_miner(ratio: float, chunk_rows: int, chunk_bytes: int, item_type):
    """Worker function of SON's first pass, with all that it needs inside (it is
    shipped by value, so workers need not have this package).

    A partition's baskets are mined in chunks of ``chunk_rows`` to twice as many, or
    fewer where these fill ``chunk_bytes``, by a depth-first search over vertical bitsets;
    the search holds the candidates of one path only, and found itemsets stream out
    in batches. A chunk without a frequent itemset gives no rows.
    """
    import math

    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("items", pa.list_(item_type)), ("local_support", pa.float64())])

    def vertical(items: pa.ListArray, least: int):
        values, of = np.unique(np.asarray(items.flatten().to_numpy(zero_copy_only=False)), return_inverse=True)
        lengths = np.asarray(items.value_lengths().fill_null(0))
        rows = np.repeat(np.arange(len(items)), lengths)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(values) + 1))
        for i, value in enumerate(values):
            mask = np.zeros(len(items), bool)
            mask[rows[order[edges[i]:edges[i + 1]]]] = True
            if mask.sum() >= least:
                yield value, int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")

    def mined(items: pa.ListArray):
        m = len(items)
        least = max(1, int(math.ceil(ratio * m - 1e-9)))
        # per item of the path: the candidates beside it and which of them comes next
        path, stack = [], [(list(vertical(items, least)), 0)]
        while stack:
            candidates, i = stack.pop()
            if i == len(candidates):
                if path:
                    path.pop()
                continue
            stack.append((candidates, i + 1))
            item, bits = candidates[i]
            path.append(item)
            yield list(path), bits.bit_count() / m
            # where nothing is longer the empty list takes the item off the path again
            stack.append(([(x, b & bits) for x, b in candidates[i + 1:] if (b & bits).bit_count() >= least], 0))

    def batches_of(items: pa.ListArray, size: int = 4096):
        found, supports = [], []
        for own, support in mined(items):
            found.append(own)
            supports.append(support)
            if len(found) == size:
                yield pa.RecordBatch.from_arrays([pa.array(found, schema.field(0).type), pa.array(supports)], schema=schema)
                found, supports = [], []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, schema.field(0).type), pa.array(supports)], schema=schema)

    def run(batches):
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch.column(0))
            rows += batch.num_rows
            size += batch.column(0).nbytes
            if size >= chunk_bytes:
                yield from batches_of(pa.concat_arrays(held))
                held, rows, size = [], 0, 0
            while rows >= 2 * chunk_rows:
                items = pa.concat_arrays(held)
                yield from batches_of(items.slice(0, chunk_rows))
                held, rows = [items.slice(chunk_rows)], rows - chunk_rows
                size = held[0].nbytes
        if rows:
            yield from batches_of(pa.concat_arrays(held))

    return run


def son_chunk(baskets: DataFrame, chunks: int, salt: str = "son") -> DataFrame:
    """Deterministic chunk id per basket (md5 bucket of the basket id)."""
    return baskets.withColumn("chunk", F.pmod(md5_unit(salt, F.col("basket_id")), F.lit(chunks)))


def local_supports(baskets: DataFrame, min_ratio: float, chunk_rows: int, n: int,
                   chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """SON pass 1: ``(items, local_support)`` for itemsets frequent in a chunk
    (relative support >= min_ratio, the global ratio).

    Chunks are runs of baskets of the existing partitions, of ``chunk_rows`` to
    twice as many and of about ``chunk_bytes`` at most. Partitions are read together, without a
    shuffle, only where they would be nearly empty (in a chunk of a few baskets
    everything is frequent); as many as tasks run at once are kept otherwise.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    item_type = baskets.schema["items"].dataType
    slots = baskets.sparkSession.sparkContext.defaultParallelism
    parts = max(1, n // chunk_rows, min(slots, n // min(chunk_rows, LEAST_CHUNK)))
    return (baskets.select(F.array_sort(F.array_distinct("items")).alias("items")).coalesce(parts)
            .mapInArrow(_chunk_miner(min_ratio, chunk_rows, chunk_bytes, to_arrow_type(item_type.elementType)),
                        f"items {item_type.simpleString()}, local_support double"))


def max_local_support(local: DataFrame, min_ratio: float) -> DataFrame:
    """Maximum of the per-chunk relative supports, then the threshold."""
    return (local.groupBy("items").agg(F.max("local_support").alias("max_local_support"))
                 .where(F.col("max_local_support") >= F.lit(min_ratio - 1e-12)))


def frequent_itemsets_son(baskets: DataFrame, min_ratio: float, chunk_rows: int = 200_000,
                          strategy: str = "auto", n: int | None = None) -> DataFrame:
    """M7: SON two-pass miner -> ``(items, support)``.

    Every globally frequent itemset is locally frequent in some chunk; pass 2
    counts the union of local results exactly on all baskets, so how the baskets
    fall into chunks never changes the answer.
    """
    with persisted(baskets) as b:
        if n is None:
            n = b.count()
        mc = resolve_min_count(n, None, min_ratio)
        local = local_supports(b, min_ratio, chunk_rows, n)
        cands = cut(max_local_support(local, min_ratio).select("items"))
        sup = cut(itemset_support(b, cands, strategy=strategy))
    return sup.where(F.col("support") >= F.lit(mc)).select("items", "support")
