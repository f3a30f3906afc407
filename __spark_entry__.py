"""

Every query reads the driver's parquet tables (or baskets Spark derives from
them) in full. Itemsets are returned as ``a|b|c`` strings (sorted items) and
doubles rounded to 6 places, so values hash the same in Spark and DuckDB.
The oracle SQL recomputes each answer independently: frequent itemsets by
level-wise self joins of (basket, item) rows, closed ones by "no immediate
superset with the same support", samples by the same md5 buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.itemsets import itemset_key, min_count_for
from basketry.operators import filters as FL
from basketry.operators.candidates import (closed_only, closed_only_any, expand_level, expand_subsets,
                                           itemset_difference, prefix_join, support_upper_bound)
from basketry.operators.encoding import distinct_items, item_support
from basketry.operators.sampling import sample_baskets, sample_fraction, sample_plan, size_variants
from basketry.operators.support import (dataset_closure, frequent_among, grouped_closure,
                                        itemset_closure, itemset_support, match_candidates)
from basketry.plans.approx import approx_closed_itemsets, majority_items, mean_item_support
from basketry.plans.closed import closed_itemsets, closed_itemsets_fp, closed_itemsets_naive, closed_lattice
from basketry.plans.evaluate import accuracy, sweep, sweep_report
from basketry.plans.frequent import (frequent_itemsets_apriori, frequent_itemsets_fp,
                                     frequent_itemsets_son, max_local_support, son_chunk)
from basketry.plans.lattice import (distinct_itemsets, itemset_lattice, level, level_union,
                                    reachable_itemsets)
from basketry.plans.rules import association_rules
from basketry.session import cut, persisted, scratch_path
from basketry.sources import tables as T
from basketry.sources.baskets import (WHITESPACE, read_baskets, read_delimited_documents, write_baskets,
                                      write_documents)
from basketry.sources.store import read_itemsets, read_sweep, write_itemsets, write_sweep



def _training_data():
    """The query modules of the training-data operators and the pipeline, if
    this copy of the repository holds them."""
    try:
        if not util.find_spec("basketry.llm.queries") or not util.find_spec("corpus_pipeline"):
            return None
    except ModuleNotFoundError as missing:
        if missing.name != "basketry.llm":
            raise
        return None
    import corpus_pipeline
    from basketry.llm import queries as operators
    return {**operators.QUERIES, "pipeline": corpus_pipeline.run}, {
        **operators.SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

FIXTURES = {
    "customer": T.customer_attribute_baskets,
    "lineitem": T.lineitem_attribute_baskets,
    "brands": T.brand_baskets_per_customer,
    "orders": T.brand_baskets_per_order,
    "words": T.word_baskets,
    "events": T.event_baskets,
}


def _b(spark, sf, name):
    return FIXTURES[name](spark, sf)


def _keyed(df: DataFrame, *extra) -> DataFrame:
    return df.select(itemset_key("items").alias("itemset"), "support", *extra)


def _r6(c):
    return F.round(c, 6)


def _frequent(spark, sf, fx, ratio):
    b = _b(spark, sf, fx)
    return frequent_itemsets_fp(b, min_ratio=ratio)


def _closed(spark, sf, fx, ratio):
    b = _b(spark, sf, fx)
    return closed_itemsets(b, min_ratio=ratio)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: closed attribute combinations of lineitem at >= 5 %
    (attribute baskets -> FP-growth -> closed filter)."""
    sf = "/root/testdata/sf0.001"
    b = T.lineitem_attribute_baskets(spark, sf)
    return _keyed(closed_itemsets_fp(b, min_ratio=0.05))


def q_m1_closed_customer(spark, sf):
    return _keyed(_closed(spark, sf, "customer", 0.01))


def q_m1_closed_lineitem(spark, sf):
    return _keyed(_closed(spark, sf, "lineitem", 0.05))


def q_m1_closed_words(spark, sf):
    return _keyed(_closed(spark, sf, "words", 0.40))


def q_m1_closed_brands(spark, sf):
    return _keyed(_closed(spark, sf, "brands", 0.5))


def q_m3_closed_naive_lineitem(spark, sf):
    return _keyed(closed_itemsets_naive(_b(spark, sf, "lineitem"), min_ratio=0.05))


def q_m3_closed_naive_words(spark, sf):
    return _keyed(closed_itemsets_naive(_b(spark, sf, "words"), min_ratio=0.45))


def q_m5_closed_fp_brands(spark, sf):
    return _keyed(closed_itemsets_fp(_b(spark, sf, "brands"), min_ratio=0.5))


def q_m5_closed_fp_customer(spark, sf):
    return _keyed(closed_itemsets_fp(_b(spark, sf, "customer"), min_ratio=0.01))


def q_m4_frequent_fp_lineitem(spark, sf):
    return _keyed(_frequent(spark, sf, "lineitem", 0.01))


def q_m4_frequent_fp_words(spark, sf):
    return _keyed(_frequent(spark, sf, "words", 0.40))


def q_m4_frequent_fp_events(spark, sf):
    return _keyed(_frequent(spark, sf, "events", 0.01))


def q_m6_apriori_brands(spark, sf):
    t = frequent_itemsets_apriori(_b(spark, sf, "brands"), min_ratio=0.7)
    return t.select(itemset_key("items").alias("itemset"), "level", "support",
                    _r6(F.col("rel_support")).alias("rel_support"), "is_frequent")


def q_m6_apriori_words(spark, sf):
    t = frequent_itemsets_apriori(_b(spark, sf, "words"), min_ratio=0.45)
    return t.select(itemset_key("items").alias("itemset"), "level", "support",
                    _r6(F.col("rel_support")).alias("rel_support"), "is_frequent")


def q_m7_son_lineitem(spark, sf):
    b = _b(spark, sf, "lineitem")
    return _keyed(frequent_itemsets_son(b, min_ratio=0.05, chunk_rows=20_000))


def q_m7_son_words(spark, sf):
    b = _b(spark, sf, "words")
    return _keyed(frequent_itemsets_son(b, min_ratio=0.40, chunk_rows=300))


def _rules_out(r):
    return r.select(itemset_key("antecedent").alias("antecedent"),
                    itemset_key("consequent").alias("consequent"), "support",
                    _r6(F.col("confidence")).alias("confidence"))


def q_m8_rules_customer(spark, sf):
    return _rules_out(association_rules(_frequent(spark, sf, "customer", 0.01), 0.5))


def q_m8_rules_words(spark, sf):
    return _rules_out(association_rules(_frequent(spark, sf, "words", 0.45), 0.7))


def q_m11_expand_subsets_words(spark, sf):
    return _keyed(expand_subsets(_closed(spark, sf, "words", 0.40)))


def q_m9_lattice_cover_customer(spark, sf):
    nodes, edges = itemset_lattice(_closed(spark, sf, "customer", 0.01), relation="cover")
    return edges.select(itemset_key("parent").alias("parent"), itemset_key("child").alias("child"))


def q_m9_closed_lattice_lineitem(spark, sf):
    _, edges = closed_lattice(_b(spark, sf, "lineitem"), min_ratio=0.05)
    return edges.select(itemset_key("parent").alias("parent"), itemset_key("child").alias("child"))


def q_m9_closed_lattice_words(spark, sf):
    nodes, edges = closed_lattice(_b(spark, sf, "words"), min_ratio=0.45)
    edge = edges.select(F.concat_ws(">", itemset_key("parent"), itemset_key("child")).alias("itemset"),
                        F.lit(None).cast("long").alias("support"), F.lit(None).cast("int").alias("level"))
    return _keyed(nodes, "level").unionByName(edge)


def q_j5_lattice_edges_lineitem(spark, sf):
    nodes, edges = itemset_lattice(_frequent(spark, sf, "lineitem", 0.05), relation="immediate")
    return edges.select(itemset_key("parent").alias("parent"), itemset_key("child").alias("child"))


def q_m10_reachable_words(spark, sf):
    nodes, edges = itemset_lattice(_frequent(spark, sf, "words", 0.45))
    r = reachable_itemsets(cut(nodes), cut(edges))
    return r.select(itemset_key("items").alias("itemset"), "depth")


def q_j6_closed_only_words(spark, sf):
    return _keyed(closed_only(cut(_frequent(spark, sf, "words", 0.45).select("items", "support"))))


def q_j6_closed_any_words(spark, sf):
    f = _frequent(spark, sf, "words", 0.45).select("items", "support")
    return _keyed(closed_only_any(f.where(F.size("items") != 2)))


def q_j7_difference_words(spark, sf):
    f = cut(_frequent(spark, sf, "words", 0.40).select("items", "support"))
    c = _closed(spark, sf, "words", 0.40)
    return _keyed(itemset_difference(f, c))


def q_j8_upper_bound_words(spark, sf):
    f = _frequent(spark, sf, "words", 0.40).select("items", "support")
    k = _closed(spark, sf, "words", 0.45)
    return support_upper_bound(f, k).select(itemset_key("items").alias("itemset"), "support", "bound")


def q_j3_expand_customer(spark, sf):
    b = _b(spark, sf, "customer")
    n = b.count()
    lvl = closed_itemsets(b, min_ratio=0.01, n=n)
    common = item_support(b, min_count_for(0.05, n))
    return expand_level(lvl.select("items"), common).select(itemset_key("items").alias("itemset"))


def q_j4_prefix_join_brands(spark, sf):
    f = _frequent(spark, sf, "brands", 0.5)
    l2 = f.where(F.size("items") == 2).select("items")
    return prefix_join(l2).select(itemset_key("items").alias("itemset"))


def _order_candidates(spark, sf):
    return _frequent(spark, sf, "orders", 0.002).select("items")


def q_j1_support_broadcast(spark, sf):
    pairs = match_candidates(_b(spark, sf, "brands"), _order_candidates(spark, sf), strategy="broadcast")
    return pairs.groupBy("items").agg(F.count(F.lit(1)).alias("support")).transform(_keyed)


def q_j2_support_index(spark, sf):
    pairs = match_candidates(_b(spark, sf, "brands"), _order_candidates(spark, sf), strategy="index")
    return pairs.groupBy("items").agg(F.count(F.lit(1)).alias("support")).transform(_keyed)


def q_a3_itemset_support(spark, sf):
    with persisted(_b(spark, sf, "brands")) as b:
        n = b.count()
        f = frequent_itemsets_fp(b, min_ratio=0.5, n=n)
        cands = prefix_join(f.where(F.size("items") == 2).select("items"))
        s = itemset_support(b, cands, n=n, min_count=min_count_for(0.5, n))
    return s.select(itemset_key("items").alias("itemset"), "support",
                    _r6(F.col("rel_support")).alias("rel_support"), "is_frequent")


def q_a4_itemset_closure_lineitem(spark, sf):
    b = _b(spark, sf, "lineitem")
    cands = frequent_itemsets_fp(b, min_ratio=0.05).select("items")
    c = itemset_closure(b, cands)
    return c.select(itemset_key("items").alias("itemset"), "support",
                    itemset_key("closure").alias("closure"))


def q_a5_dataset_closure(spark, sf):
    return dataset_closure(_b(spark, sf, "customer")).select(itemset_key("closure").alias("closure"))


def q_a5_f1_closure_of_containing(spark, sf):
    b = FL.containing(_b(spark, sf, "customer"), ["nat=NATION_7"])
    return dataset_closure(b).select(itemset_key("closure").alias("closure"))


def q_a6_grouped_closure_lineitem(spark, sf):
    b = T.lineitem_grouped_attribute_baskets(spark, sf)
    g = grouped_closure(b, "grp", max_group=20)
    return g.select("grp", itemset_key("closure").alias("closure"))


def q_a7_frequent_among_customer(spark, sf):
    b = _b(spark, sf, "customer")
    listed = distinct_items(b).where(F.col("item").startswith("nat="))
    return frequent_among(b, listed, 0.04 * b.count())


def q_a1_item_support_words(spark, sf):
    b = _b(spark, sf, "words")
    n = b.count()
    return item_support(b, min_count_for(0.35, n))


def q_a2_distinct_items_lineitem(spark, sf):
    return distinct_items(_b(spark, sf, "lineitem"))


def _customer_fraction(n):
    return sample_fraction(n, min_count_for(0.1, n), 0.1)[1]


def q_a8_majority_items_customer(spark, sf):
    b = _b(spark, sf, "customer")
    n = b.count()
    f = _customer_fraction(n)
    return majority_items(b, f, min_count_for(0.1, n) * f).select("item", "votes")


def q_a9_mean_item_support_customer(spark, sf):
    b = _b(spark, sf, "customer")
    f = _customer_fraction(b.count())
    m = mean_item_support(b, f)
    return m.select("item", _r6(F.col("mean_support")).alias("mean_support"), "n_samples")


def q_a10_accuracy_words(spark, sf):
    ap = _closed(spark, sf, "words", 0.45)
    ex = _closed(spark, sf, "words", 0.40)
    a = accuracy(ap, ex)
    return a.select(*[_r6(F.col(c)).alias(c) for c in a.columns])


def q_a11_max_local_support_words(spark, sf):
    b = son_chunk(_b(spark, sf, "words"), 4)
    sizes = b.groupBy("chunk").agg(F.count(F.lit(1)).alias("m"))
    cnt = (b.select("chunk", F.explode("items").alias("item"))
            .groupBy("chunk", "item").agg(F.count(F.lit(1)).alias("c")))
    local = cnt.join(sizes, "chunk").select("chunk", F.array("item").alias("items"),
                                            (F.col("c") / F.col("m")).alias("local_support"))
    r = max_local_support(local, 0.45)
    return r.select(itemset_key("items").alias("itemset"),
                    _r6(F.col("max_local_support")).alias("max_local_support"))


def q_a12_distinct_itemsets_words(spark, sf):
    u = _closed(spark, sf, "words", 0.45).unionByName(_closed(spark, sf, "words", 0.40))
    return _keyed(distinct_itemsets(u))


def q_a13_level_words(spark, sf):
    nodes, _ = itemset_lattice(_frequent(spark, sf, "words", 0.40))
    return _keyed(level(cut(nodes), 2))


def q_a13_level_union_words(spark, sf):
    f = _frequent(spark, sf, "words", 0.45)
    u = level_union([f.where(F.size("items") == i) for i in (1, 2, 3)])
    return _keyed(u, "level")


def q_f1_containing_brands(spark, sf):
    b = FL.containing(_b(spark, sf, "brands"), ["Brand#13", "Brand#21"])
    return b.select("basket_id", itemset_key("items").alias("itemset"))


def q_f2_min_support_words(spark, sf):
    b = _b(spark, sf, "words")
    n = b.count()
    return _keyed(FL.min_support(frequent_itemsets_fp(b, min_ratio=0.45, n=n),
                                 min_count=min_count_for(0.5, n), strict=True))


def q_f3_only_common_brands(spark, sf):
    with persisted(_b(spark, sf, "brands")) as b:
        n = b.count()
        f = frequent_itemsets_fp(b, min_ratio=0.5, n=n).select("items", "support")
        common = cut(item_support(b, min_count_for(0.6, n)))
    return _keyed(FL.only_common(f, common))


def q_f4_canonical_events(spark, sf):
    b = _b(spark, sf, "events")
    return (b.groupBy(itemset_key("items").alias("itemset"))
             .agg(F.count(F.lit(1)).alias("n_baskets")))


def q_f5_explode_events(spark, sf):
    return FL.explode_items(_b(spark, sf, "events"))


def q_f6_scale_support_customer(spark, sf):
    b = _b(spark, sf, "customer")
    n = b.count()
    s = item_support(sample_baskets(b, 0.3, seed=42))
    return FL.scale_support(s, 1 / 0.3, n).select("item", "support")


def q_p1_sample_customer(spark, sf):
    b = sample_baskets(_b(spark, sf, "customer"), 0.3, seed=42)
    return b.select("basket_id", itemset_key("items").alias("itemset"))


# The reference's threshold sweep ratios (the newer experiments).
SWEEP_RATIOS = [0.6, 0.65, 0.7, 0.75, 0.8]


def q_p2_sample_plan(spark, sf):
    b = _b(spark, sf, "customer")
    counts = b.agg(F.count(F.lit(1)).alias("n"))
    params = counts.select(F.col("n"), F.explode(F.array(*[F.lit(r) for r in SWEEP_RATIOS])).alias("ratio"))
    params = params.select("n", "ratio", F.ceil(F.col("ratio") * F.col("n")).cast("double").alias("threshold"),
                           F.lit(0.1).alias("epsilon"), F.lit(0.1).alias("alpha"))
    p = sample_plan(params)
    return p.select("n", _r6(F.col("ratio")).alias("ratio"), "threshold", "sample_size",
                    _r6(F.col("fraction")).alias("fraction"),
                    _r6(F.col("scaled_threshold")).alias("scaled_threshold"),
                    "sample_size_b", _r6(F.col("sample_size_c")).alias("sample_size_c"))


def q_s3_document_words(spark, sf):
    b = _b(spark, sf, "words")
    return b.select("basket_id", F.size("items").alias("n_items"), itemset_key("items").alias("itemset"))


def q_s4_customer_baskets(spark, sf):
    return _b(spark, sf, "customer").select("basket_id", itemset_key("items").alias("itemset"))


def q_s4_brands_per_customer(spark, sf):
    return _b(spark, sf, "brands").select("basket_id", itemset_key("items").alias("itemset"))


def q_s4_event_baskets(spark, sf):
    return _b(spark, sf, "events").select("basket_id", itemset_key("items").alias("itemset"))


def q_s5_s1_roundtrip_brands(spark, sf):
    path = scratch_path(spark, "brand_baskets")
    write_baskets(_b(spark, sf, "brands"), path)
    back = read_baskets(spark, path)
    return (back.groupBy(itemset_key("items").alias("itemset"))
                .agg(F.count(F.lit(1)).alias("n_baskets")))


def q_s5_s1_roundtrip_lineitem(spark, sf):
    path = scratch_path(spark, "lineitem_baskets")
    write_baskets(_b(spark, sf, "lineitem"), path)
    back = read_baskets(spark, path, escaped=True)
    return (back.groupBy(itemset_key("items").alias("itemset"))
                .agg(F.count(F.lit(1)).alias("n_baskets")))


def q_s1_bigint_parts(spark, sf):
    path = scratch_path(spark, "part_baskets")
    write_baskets(T.part_baskets_per_order(spark, sf), path, sep=",")
    back = read_baskets(spark, path, sep=",", item_type="bigint", num_partitions=8)
    return (back.groupBy(F.size("items").cast("long").alias("n_items"), itemset_key("items").alias("itemset"))
                .agg(F.count(F.lit(1)).alias("n_baskets")))


def _written_in_order(spark, baskets, sep=" "):
    """The baskets written as text lines in the order of their ids."""
    path = scratch_path(spark, "ordered_baskets")
    write_baskets(baskets.orderBy("basket_id"), path, sep=sep)
    return path


def q_s1_line_ids_parts(spark, sf):
    path = _written_in_order(spark, T.part_baskets_per_order(spark, sf), ",")
    back = read_baskets(spark, path, sep=",", item_type="bigint")
    return back.select("basket_id", itemset_key("items").alias("itemset"))


def q_p1_sample_text_brands(spark, sf):
    back = read_baskets(spark, _written_in_order(spark, _b(spark, sf, "brands")))
    return sample_baskets(back, 0.3, seed=42).select("basket_id", itemset_key("items").alias("itemset"))


def q_s1_hashed_brands(spark, sf):
    path = scratch_path(spark, "brand_baskets")
    baskets = _b(spark, sf, "brands")
    write_baskets(baskets, path)
    back = read_baskets(spark, path, hashed=True)
    names = distinct_items(baskets).select(F.col("item").alias("name"), F.xxhash64("item").alias("item"))
    return item_support(back).join(names, "item", "left").select(F.col("name").alias("item"), "support")


def q_s2_delimited_documents(spark, sf):
    path = scratch_path(spark, "documents")
    write_documents(T.table(spark, sf, "documents").select("text"), "text", path)
    back = read_delimited_documents(spark, path)
    back = back.where(F.size("items") > 0)
    return back.select(F.size("items").alias("n_items"), itemset_key("items").alias("itemset"))


# The reference's size-variant labels and fractions.
SIZE_FRACTIONS = {"xsmall": 0.2, "small": 0.4, "medium": 0.6, "large": 0.8, "xlarge": 1.0}


def q_s6_size_variants_customer(spark, sf):
    v = size_variants(_b(spark, sf, "customer"), SIZE_FRACTIONS, seed=42)
    return v.select("size_label", "basket_id", itemset_key("items").alias("itemset"))


def q_s8_lattice_roundtrip_customer(spark, sf):
    nodes, edges = itemset_lattice(_closed(spark, sf, "customer", 0.01), relation="cover")
    path = scratch_path(spark, "lattice")
    write_itemsets(nodes, edges, path)
    n2, e2 = read_itemsets(spark, path)
    edge = e2.select(F.concat_ws(">", itemset_key("parent"), itemset_key("child")).alias("itemset"),
                     F.lit(None).cast("long").alias("support"), F.lit(None).cast("int").alias("level"))
    return _keyed(n2, "level").unionByName(edge)


def q_s9_sweep_roundtrip_customer(spark, sf):
    r = sweep(spark, _b(spark, sf, "customer"), "threshold", "ratio", [0.1], algorithms=("exact",))
    path = scratch_path(spark, "sweep")
    write_sweep(r, path)
    back = read_sweep(spark, path)
    return back.where(~F.col("measure").endswith("time")).select("sweep", "param_label", "param_value",
                                                         "algorithm", "run", "measure",
                                                         _r6(F.col("value")).alias("value"))


def q_m2_approx_closed_events(spark, sf):
    b = _b(spark, sf, "events")
    n = b.count()
    a = approx_closed_itemsets(b, min_count_for(0.01, n), 0.1)
    return a.select(itemset_key("items").alias("itemset"), "support", "meets_threshold")


def q_m2_approx_closed_customer(spark, sf):
    b = _b(spark, sf, "customer")
    n = b.count()
    a = approx_closed_itemsets(b, min_count_for(0.05, n), 0.1)
    return a.select(itemset_key("items").alias("itemset"), "support", "meets_threshold")


def q_m12_sweep_customer(spark, sf):
    b = _b(spark, sf, "customer")
    return _untimed(sweep(spark, b, "threshold", "ratio", [0.05, 0.1], base={"epsilon": 0.1}))


# Labels of the sweeps' five places, and the epsilon and alpha swept.
SWEEP_LABELS = ["xsmall", "small", "medium", "large", "xlarge"]
SWEEP_STEPS = [1e-5, 1e-4, 1e-3, 1e-2, 1e-1]
SWEEP_BASE = {"ratio": 0.1, "epsilon": 0.001, "alpha": 0.1}


def _untimed(results):
    """The rows of a sweep that a second run repeats."""
    return results.where(~F.col("measure").endswith("time")).withColumn("value", _r6(F.col("value")))


def q_m12_sweep_alpha_customer(spark, sf):
    return _untimed(sweep(spark, _b(spark, sf, "customer"), "alpha", "alpha", SWEEP_STEPS[::2], base=SWEEP_BASE))


def q_m12_sweep_epsilon_customer(spark, sf):
    return _untimed(sweep(spark, _b(spark, sf, "customer"), "epsilon", "epsilon", SWEEP_STEPS[::2], base=SWEEP_BASE))


def q_m12_sweep_size_customer(spark, sf):
    sizes = [SIZE_FRACTIONS[k] for k in SWEEP_LABELS[::2]]
    return _untimed(sweep(spark, _b(spark, sf, "customer"), "size", "fraction", sizes, base=SWEEP_BASE))


def q_m13_report_epsilon_customer(spark, sf):
    r = sweep(spark, _b(spark, sf, "customer"), "epsilon", "epsilon", SWEEP_STEPS, base=SWEEP_BASE)
    rep = sweep_report(r.where(~F.col("measure").endswith("time")), axis=dict(zip(SWEEP_STEPS, SWEEP_LABELS)),
                       flat=("exact", "fpgrowth"))
    return rep.select("sweep", "param_label", "param_value", "axis", "place", "measure",
                      *[_r6(F.col(c)).alias(c) for c in ("exact", "fpgrowth", "sampled")])


def q_m13_sweep_report_customer(spark, sf):
    b = _b(spark, sf, "customer")
    r = sweep(spark, b, "threshold", "ratio", [0.05, 0.1], base={"epsilon": 0.1})
    rep = sweep_report(r.where(~F.col("measure").endswith("time")))
    return rep.select("sweep", "param_label", "param_value", "measure",
                      *[_r6(F.col(c)).alias(c) for c in ("exact", "fpgrowth", "sampled")])


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
_TRAINING_DATA = _training_data()
if _TRAINING_DATA:
    _QUERIES.update(_TRAINING_DATA[0])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


# --------------------------------------------------------------------------
# DuckDB oracle
# --------------------------------------------------------------------------

_CUST_JOIN = ("customer JOIN nation ON c_nationkey = n_nationkey "
              "JOIN region ON n_regionkey = r_regionkey")
_LI_JOIN = ("(SELECT row_number() OVER () AS rid, * FROM lineitem) l "
            "JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
            "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_WS = WHITESPACE

SQL_BI = {
    "customer": (f"SELECT c_custkey AS basket_id, unnest(['seg=' || c_mktsegment, 'nat=' || n_name, "
                 f"'reg=' || r_name]) AS item FROM {_CUST_JOIN}",
                 f"SELECT count(*) AS n FROM {_CUST_JOIN}"),
    "lineitem": (f"SELECT rid AS basket_id, unnest(['flag=' || l_returnflag, 'status=' || l_linestatus, "
                 f"'brand=' || p_brand, 'type=' || p_type, 'nat=' || n_name, 'reg=' || r_name]) AS item "
                 f"FROM {_LI_JOIN}",
                 f"SELECT count(*) AS n FROM {_LI_JOIN}"),
    "brands": ("SELECT o_custkey AS basket_id, p_brand AS item FROM lineitem "
               "JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey",
               "SELECT count(DISTINCT o_custkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey "
               "JOIN orders ON l_orderkey = o_orderkey"),
    "orders": ("SELECT l_orderkey AS basket_id, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey",
               "SELECT count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "words": (f"SELECT doc_id AS basket_id, unnest(regexp_split_to_array(lower(text), '{_WS}')) AS item "
              f"FROM documents",
              "SELECT count(*) AS n FROM documents"),
    "events": ("SELECT CAST(user_id AS VARCHAR) || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS basket_id, "
               "event_type AS item FROM events",
               "SELECT count(DISTINCT CAST(user_id AS VARCHAR) || ':' || CAST(CAST(ts AS DATE) AS VARCHAR)) "
               "AS n FROM events"),
}

_KEY = "array_to_string(items, '|')"


def _sql(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def _base_ctes(fx: str, ratio: float, p: str = "", fraction: float = 1.0) -> list[str]:
    bi, n = SQL_BI[fx]
    part = ""
    if fraction < 1.0:
        # a sweep's data set: md5 buckets of seed 7 (fixtures without empty baskets)
        part = f" AND {_md5_unit(repr('7:'), 'basket_id')} < {fraction!r} * 4294967296"
        n = f"SELECT count(DISTINCT basket_id) AS n FROM {p}bi"
    return [f"{p}bi AS (SELECT DISTINCT basket_id, item FROM ({bi}) WHERE item IS NOT NULL AND item <> ''{part})",
            f"{p}nb AS ({n})",
            f"{p}mc AS (SELECT CAST(ceil({ratio!r} * n - 1e-9) AS BIGINT) AS m FROM {p}nb)"]


def _freq_ctes(fx: str, ratio: float, p: str = "", K: int = 8, fraction: float = 1.0) -> list[str]:
    """CTE ``{p}fa(items, size, support)``: all frequent itemsets, level by
    level: each frequent (k-1)-set joins the baskets holding its first item,
    keeps those holding all its items, and counts the larger items they hold."""
    c = _base_ctes(fx, ratio, p, fraction)
    c.append(f"{p}f1 AS (SELECT item AS i1, count(*) AS support FROM {p}bi GROUP BY item "
             f"HAVING count(*) >= (SELECT m FROM {p}mc))")
    c.append(f"{p}bf AS (SELECT basket_id, item FROM {p}bi WHERE item IN (SELECT i1 FROM {p}f1))")
    c.append(f"{p}cb AS (SELECT basket_id, list_sort(list(item)) AS its FROM {p}bf GROUP BY basket_id)")
    c.append(f"{p}g1 AS (SELECT [i1] AS items, support FROM {p}f1)")
    for k in range(2, K + 1):
        c.append(f"{p}g{k} AS MATERIALIZED (SELECT items, count(*) AS support FROM (SELECT list_append(q.items, "
                 f"unnest(list_filter(c.its, lambda e: e > q.items[len(q.items)]))) AS items "
                 f"FROM {p}g{k - 1} q JOIN {p}bf x ON x.item = q.items[1] "
                 f"JOIN {p}cb c ON c.basket_id = x.basket_id WHERE list_has_all(c.its, q.items)) "
                 f"GROUP BY items HAVING count(*) >= (SELECT m FROM {p}mc))")
    union = " UNION ALL ".join(f"SELECT items, {k} AS size, support FROM {p}g{k}" for k in range(1, K + 1))
    c.append(f"{p}fa AS ({union})")
    return c


def _closed_cte(p: str = "") -> str:
    return (f"{p}fc AS (SELECT a.items, a.size, a.support FROM {p}fa a WHERE NOT EXISTS ("
            f"SELECT 1 FROM {p}fa b WHERE b.size = a.size + 1 AND b.support = a.support "
            f"AND list_has_all(b.items, a.items)))")


def _sql_frequent(fx, ratio):
    return _sql(_freq_ctes(fx, ratio), f"SELECT {_KEY} AS itemset, support FROM fa")


def _sql_closed(fx, ratio):
    return _sql(_freq_ctes(fx, ratio) + [_closed_cte()], f"SELECT {_KEY} AS itemset, support FROM fc")


def _sql_rules(fx, ratio, conf):
    final = (f"SELECT array_to_string(x.items, '|') AS antecedent, "
             f"array_to_string(list_filter(z.items, lambda e: NOT list_contains(x.items, e)), '|') AS consequent, "
             f"z.support AS support, round(CAST(z.support AS DOUBLE) / x.support, 6) AS confidence "
             f"FROM fa z JOIN fa x ON x.size < z.size AND list_has_all(z.items, x.items) "
             f"WHERE z.size >= 2 AND CAST(z.support AS DOUBLE) / x.support >= {conf!r}")
    return _sql(_freq_ctes(fx, ratio), final)


def _sql_apriori(fx, ratio, K=6, min_level=1):
    """The Apriori support table: level-1 counts of every item, then for each
    level the prefix-join candidates of the previous frequent level that occur
    in at least one basket: a frequent set with a larger item of a basket that holds it,
    whose other generating set is frequent too."""
    c = _base_ctes(fx, ratio)
    c.append("c1 AS MATERIALIZED (SELECT [item] AS items, count(*) AS support FROM bi GROUP BY item)")
    c.append("l1 AS MATERIALIZED (SELECT items FROM c1 WHERE support >= (SELECT m FROM mc))")
    c.append("bf AS MATERIALIZED (SELECT basket_id, item FROM bi WHERE [item] IN (SELECT items FROM l1))")
    c.append("cb AS MATERIALIZED (SELECT basket_id, list_sort(list(item)) AS its FROM bf GROUP BY basket_id)")
    for k in range(2, K + 1):
        other = f"list_append(list_slice(items, 1, {k - 2}), items[{k}])"
        c.append(f"c{k} AS MATERIALIZED (SELECT items, count(*) AS support FROM (SELECT list_append(q.items, "
                 f"unnest(list_filter(cb.its, lambda e: e > q.items[{k - 1}]))) AS items "
                 f"FROM l{k - 1} q JOIN bf x ON x.item = q.items[1] JOIN cb ON cb.basket_id = x.basket_id "
                 f"WHERE list_has_all(cb.its, q.items)) WHERE {other} IN (SELECT items FROM l{k - 1}) GROUP BY items)")
        c.append(f"l{k} AS MATERIALIZED (SELECT items FROM c{k} WHERE support >= (SELECT m FROM mc))")
    union = " UNION ALL ".join(f"SELECT items, {k} AS level, support FROM c{k}" for k in range(min_level, K + 1))
    final = (f"SELECT {_KEY} AS itemset, level, support, "
             f"round(CAST(support AS DOUBLE) / (SELECT n FROM nb), 6) AS rel_support, "
             f"support >= (SELECT m FROM mc) AS is_frequent FROM ({union})")
    return _sql(c, final)


def _md5_unit(seed_expr: str, key_expr: str) -> str:
    return f"CAST('0x' || substr(md5({seed_expr} || CAST({key_expr} AS VARCHAR)), 1, 8) AS BIGINT)"


def _baskets_sql(fx):
    bi, _ = SQL_BI[fx]
    return (f"SELECT basket_id, list_sort(list(DISTINCT item)) AS items FROM ({bi}) "
            f"WHERE item IS NOT NULL AND item <> '' GROUP BY basket_id")


def _d(x: float) -> str:
    """A DOUBLE literal (DuckDB reads plain decimals as DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def _size_a(n: str, t: str, eps: float = 0.1, alpha: float = 0.1) -> str:
    return (f"ceil({_d(5.0)} * (ln({_d(1.0)} / {_d(eps)}) * {_d(2.0)} * {n}) / "
            f"(pow({_d(1.0)} - {_d(alpha)}, 2) * {t}))")


def _customer_fraction_sql():
    # sample fraction of P2(a) for threshold ceil(.1 n), eps .1, alpha .1, clamped to 1
    t = "CAST(ceil(0.1 * n - 1e-9) AS BIGINT)"
    return f"(SELECT least({_d(1.0)}, {_size_a('n', t)} / n) AS f, {t} AS t FROM nb)"


def _per_sample_counts_sql():
    parts = []
    for i, s in enumerate((42, 43, 44)):
        parts.append(f"SELECT {i} AS sample, item, count(*) AS support FROM bi "
                     f"WHERE {_md5_unit(repr(f'{s}:'), 'basket_id')} < (SELECT f FROM fr) * 4294967296 "
                     f"GROUP BY item")
    return " UNION ALL ".join(parts)


def _sql_approx_small(fx: str, ratio: float, eps: float, alpha: float = 0.1) -> str:
    """M2 on a small item universe with bitmasks: md5 samples, majority items,
    closed sets of sample 1 (every sub-mask of a sample basket is a
    candidate, closed when the AND of its baskets equals it), exact recount."""
    def unit(seed):
        return _md5_unit(repr(f"{seed}:"), "basket_id")
    c = _base_ctes(fx, ratio)
    c += [
        "it AS (SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 AS BIGINT) AS b "
        "FROM (SELECT DISTINCT item FROM bi))",
        "bm AS (SELECT basket_id, CAST(sum(CAST(1 AS BIGINT) << b) AS BIGINT) AS m FROM bi JOIN it USING (item) "
        "GROUP BY basket_id)",
        f"fr AS (SELECT m AS t, least({_d(1.0)}, {_size_a('n', 'm', eps, alpha)} / n) AS f FROM mc, nb)",
        "sc AS (SELECT t, f, t * f AS scaled, CAST(ceil(t * f - 1e-9) AS BIGINT) AS smc FROM fr)",
        "ps AS (" + " UNION ALL ".join(
            f"SELECT {i} AS sample, item, count(*) AS support FROM bi "
            f"WHERE {unit(s)} < (SELECT f FROM sc) * 4294967296 GROUP BY item"
            for i, s in enumerate((42, 43, 44))) + ")",
        "cm AS (SELECT CAST(coalesce(sum(CAST(1 AS BIGINT) << b), 0) AS BIGINT) AS cmask FROM it WHERE item IN "
        "(SELECT item FROM ps WHERE support >= (SELECT scaled FROM sc) GROUP BY item "
        "HAVING count(DISTINCT sample) >= 2))",
        f"s1 AS (SELECT basket_id, m FROM bm WHERE {unit(42)} < (SELECT f FROM sc) * 4294967296)",
        "cand AS (SELECT DISTINCT c FROM (SELECT unnest(range(1, m + 1)) AS c, m FROM s1) WHERE (c & m) = c)",
        "cl AS (SELECT cand.c FROM cand JOIN s1 ON (s1.m & cand.c) = cand.c GROUP BY cand.c "
        "HAVING count(*) >= (SELECT smc FROM sc) AND bit_and(s1.m) = cand.c "
        "AND (cand.c & (SELECT cmask FROM cm)) = cand.c)",
        "rc AS (SELECT cl.c, count(*) AS support FROM cl JOIN bm ON (bm.m & cl.c) = cl.c GROUP BY cl.c)"]
    final = ("SELECT (SELECT string_agg(item, '|' ORDER BY item) FROM it WHERE (rc.c >> it.b) & 1 = 1) AS itemset, "
             "support, support >= (SELECT t FROM sc) AS meets_threshold FROM rc")
    return _sql(c, final)


def _approx_short_ctes(fx: str, ratio: float, eps: float, alpha: float = 0.1, p: str = "",
                       fraction: float = 1.0) -> list[str]:
    """CTEs ending in ``{p}rc(items, support)``: M2 for short baskets with
    lists. Every closed set of sample 1 is a subset of some sample basket, so
    the candidates are all non-empty subsets of the sample baskets; a
    candidate is closed when no outside item occurs in all sample baskets
    containing it."""
    def unit(seed):
        return _md5_unit(repr(f"{seed}:"), "basket_id")
    c = _base_ctes(fx, ratio, p, fraction)
    c += [
        f"{p}bl AS (SELECT basket_id, list_sort(list(item)) AS its FROM {p}bi GROUP BY basket_id)",
        f"{p}fr AS (SELECT m AS t, least({_d(1.0)}, {_size_a('n', 'm', eps, alpha)} / n) AS f FROM {p}mc, {p}nb)",
        f"{p}sc AS (SELECT t, f, t * f AS scaled, CAST(ceil(t * f - 1e-9) AS BIGINT) AS smc FROM {p}fr)",
        f"{p}ps AS (" + " UNION ALL ".join(
            f"SELECT {i} AS sample, item, count(*) AS support FROM {p}bi "
            f"WHERE {unit(s)} < (SELECT f FROM {p}sc) * 4294967296 GROUP BY item"
            for i, s in enumerate((42, 43, 44))) + ")",
        f"{p}cm AS (SELECT list(item) AS common FROM (SELECT item FROM {p}ps WHERE support >= "
        f"(SELECT scaled FROM {p}sc) GROUP BY item HAVING count(DISTINCT sample) >= 2))",
        f"{p}s1 AS (SELECT basket_id, its FROM {p}bl WHERE {unit(42)} < (SELECT f FROM {p}sc) * 4294967296)",
        f"{p}cand AS (SELECT DISTINCT list_filter(its, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS items FROM "
        f"(SELECT its, unnest(range(1, CAST(1 AS BIGINT) << len(its))) AS m FROM {p}s1))",
        f"{p}hit AS (SELECT c.items, s.basket_id, s.its FROM {p}cand c JOIN {p}s1 s ON list_has_all(s.its, c.items))",
        f"{p}sup AS (SELECT items, count(*) AS support FROM {p}hit GROUP BY items)",
        f"{p}co AS (SELECT items, e, count(*) AS c FROM (SELECT items, unnest(its) AS e FROM {p}hit) "
        f"WHERE NOT list_contains(items, e) GROUP BY items, e)",
        f"{p}cl AS (SELECT u.items FROM {p}sup u WHERE u.support >= (SELECT smc FROM {p}sc) "
        f"AND list_has_all((SELECT common FROM {p}cm), u.items) AND NOT EXISTS (SELECT 1 FROM {p}co o "
        f"WHERE o.items = u.items AND o.c = u.support))",
        f"{p}rc AS (SELECT l.items, count(*) AS support FROM {p}cl l JOIN {p}bl b ON list_has_all(b.its, l.items) "
        f"GROUP BY l.items)"]
    return c


def _sql_approx_short(fx: str, ratio: float, eps: float, alpha: float = 0.1) -> str:
    final = (f"SELECT {_KEY} AS itemset, support, support >= (SELECT t FROM sc) AS meets_threshold FROM rc")
    return _sql(_approx_short_ctes(fx, ratio, eps, alpha), final)


def _accuracy_ctes(approx: str, exact: str, p: str) -> list[str]:
    """CTE ``{p}acc(not_identified, approx_overhead, approx_alpha_mean)``
    for two tables ``(items, support)``."""
    return [
        f"{p}cov AS (SELECT x.items, CASE WHEN EXISTS (SELECT 1 FROM {approx} y WHERE list_has_all(y.items, x.items)) "
        f"THEN 1 ELSE 0 END AS c FROM {exact} x)",
        f"{p}rat AS (SELECT y.support / coalesce((SELECT min(x.support) FROM {exact} x WHERE x.items = y.items), "
        f"(SELECT min(x.support) FROM {exact} x WHERE list_has_all(y.items, x.items))) AS r FROM {approx} y)",
        f"{p}acc AS (SELECT (SELECT (count(*) - sum(c)) / count(*) FROM {p}cov) AS not_identified, "
        f"(SELECT count(*) FROM {approx}) / (SELECT count(*) FROM {exact}) AS approx_overhead, "
        f"(SELECT avg(r) FROM {p}rat) AS approx_alpha_mean)"]


def _sweep_rows_sql(fx: str, sweep_name: str, param: str, values: list, base: dict | None = None,
                    algorithms=("exact", "fpgrowth", "sampled")) -> tuple[list[str], str]:
    """CTEs and a UNION of the deterministic sweep rows (no timings), every grid
    cell mined by itself."""
    ctes, parts = [], []
    for i, v in enumerate(values):
        cell = {"ratio": 0.7, "epsilon": 0.1, "alpha": 0.1, "fraction": 1.0} | (base or {}) | {param: v}
        e, a = f"e{i}", f"a{i}"
        ctes += _freq_ctes(fx, cell["ratio"], p=e, K=4, fraction=cell["fraction"]) + [_closed_cte(e)]
        ctes.append(f"{e}ex AS (SELECT items, support FROM {e}fc)")
        head = f"'{sweep_name}' AS sweep, '{param}' AS param_label, CAST({float(v)!r} AS DOUBLE) AS param_value"
        parts.append(f"SELECT {head}, 'exact' AS algorithm, 0 AS run, 'num_cis' AS measure, "
                     f"CAST(count(*) AS DOUBLE) AS value FROM {e}ex")
        if "fpgrowth" in algorithms:
            ctes.append(f"{e}fp AS (SELECT items, support FROM {e}fa)")
            ctes += _accuracy_ctes(f"{e}fp", f"{e}ex", f"{e}f")
        if "sampled" in algorithms:
            ctes += _approx_short_ctes(fx, cell["ratio"], cell["epsilon"], cell["alpha"], p=a, fraction=cell["fraction"])
            ctes += _accuracy_ctes(f"{a}rc", f"{e}ex", f"{e}s")
        for alg, acc in (("fpgrowth", f"{e}facc"), ("sampled", f"{e}sacc")):
            if alg in algorithms:
                for m in ("not_identified", "approx_overhead", "approx_alpha_mean"):
                    parts.append(f"SELECT {head}, '{alg}' AS algorithm, 0 AS run, '{m}' AS measure, "
                                 f"CAST({m} AS DOUBLE) AS value FROM {acc}")
    return ctes, " UNION ALL ".join(parts)


def _sql_sweep(*args, **kw):
    ctes, rows = _sweep_rows_sql(*args, **kw)
    return _sql(ctes, f"SELECT sweep, param_label, param_value, algorithm, run, measure, round(value, 6) AS value FROM ({rows})")


def _oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    o["m1_closed_customer"] = _sql_closed("customer", 0.01)
    o["m1_closed_lineitem"] = _sql_closed("lineitem", 0.05)
    o["m1_closed_words"] = _sql_closed("words", 0.40)
    o["m1_closed_brands"] = _sql_closed("brands", 0.5)
    o["m3_closed_naive_lineitem"] = _sql_closed("lineitem", 0.05)
    o["m3_closed_naive_words"] = _sql_closed("words", 0.45)
    o["m5_closed_fp_brands"] = _sql_closed("brands", 0.5)
    o["m5_closed_fp_customer"] = _sql_closed("customer", 0.01)
    o["m4_frequent_fp_lineitem"] = _sql_frequent("lineitem", 0.01)
    o["m4_frequent_fp_words"] = _sql_frequent("words", 0.40)
    o["m4_frequent_fp_events"] = _sql_frequent("events", 0.01)
    o["m6_apriori_brands"] = _sql_apriori("brands", 0.7)
    o["m6_apriori_words"] = _sql_apriori("words", 0.45, K=7)
    o["m7_son_lineitem"] = _sql_frequent("lineitem", 0.05)
    o["m7_son_words"] = _sql_frequent("words", 0.40)
    o["m8_rules_customer"] = _sql_rules("customer", 0.01, 0.5)
    o["m8_rules_words"] = _sql_rules("words", 0.45, 0.7)
    o["m11_expand_subsets_words"] = _sql_frequent("words", 0.40)
    o["m9_lattice_cover_customer"] = _sql(
        _freq_ctes("customer", 0.01) + [
            _closed_cte(),
            "pr AS (SELECT a.items AS parent, b.items AS child FROM fc a JOIN fc b "
            "ON a.size < b.size AND list_has_all(b.items, a.items))",
            "tw AS (SELECT DISTINCT p1.parent, p2.child FROM pr p1 JOIN pr p2 ON p1.child = p2.parent)"],
        "SELECT array_to_string(parent, '|') AS parent, array_to_string(child, '|') AS child FROM pr "
        "WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw.parent = pr.parent AND tw.child = pr.child)")
    def covers(fx, ratio):
        return _freq_ctes(fx, ratio) + [
            _closed_cte(),
            "pr AS MATERIALIZED (SELECT a.items AS parent, b.items AS child FROM fc a JOIN fc b "
            "ON a.size < b.size AND list_has_all(b.items, a.items))",
            "tw AS (SELECT DISTINCT p1.parent, p2.child FROM pr p1 JOIN pr p2 ON p1.child = p2.parent)",
            "ed AS (SELECT array_to_string(parent, '|') AS parent, array_to_string(child, '|') AS child FROM pr "
            "WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw.parent = pr.parent AND tw.child = pr.child))"]

    o["m9_closed_lattice_lineitem"] = _sql(covers("lineitem", 0.05), "SELECT parent, child FROM ed")
    o["m9_closed_lattice_words"] = _sql(
        covers("words", 0.45), f"SELECT {_KEY} AS itemset, support, CAST(size AS INTEGER) AS level FROM fc UNION ALL "
                               "SELECT parent || '>' || child, NULL, NULL FROM ed")
    o["j5_lattice_edges_lineitem"] = _sql(
        _freq_ctes("lineitem", 0.05),
        "SELECT array_to_string(a.items, '|') AS parent, array_to_string(b.items, '|') AS child "
        "FROM fa a JOIN fa b ON b.size = a.size + 1 AND list_has_all(b.items, a.items)")
    o["m10_reachable_words"] = _sql(_freq_ctes("words", 0.45), f"SELECT {_KEY} AS itemset, size - 1 AS depth FROM fa")
    o["j6_closed_only_words"] = _sql_closed("words", 0.45)
    o["j6_closed_any_words"] = _sql(
        _freq_ctes("words", 0.45),
        f"SELECT {_KEY} AS itemset, support FROM fa a WHERE size <> 2 AND NOT EXISTS (SELECT 1 FROM fa b "
        "WHERE b.size <> 2 AND b.size > a.size AND b.support = a.support AND list_has_all(b.items, a.items))")
    o["j7_difference_words"] = _sql(
        _freq_ctes("words", 0.40) + [_closed_cte()],
        f"SELECT {_KEY} AS itemset, support FROM fa WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.items = fa.items)")
    o["j8_upper_bound_words"] = _sql(
        _freq_ctes("words", 0.40) + _freq_ctes("words", 0.45, p="h") + [_closed_cte("h")],
        "SELECT array_to_string(fa.items, '|') AS itemset, fa.support, "
        "(SELECT min(k.support) FROM hfc k WHERE list_has_all(fa.items, k.items)) AS bound FROM fa")
    o["j3_expand_customer"] = _sql(
        _freq_ctes("customer", 0.01) + [_closed_cte(), "cm AS (SELECT item FROM bi GROUP BY item "
                                       "HAVING count(*) >= (SELECT CAST(ceil(0.05 * n - 1e-9) AS BIGINT) FROM nb))"],
        "SELECT DISTINCT array_to_string(list_sort(list_append(fc.items, cm.item)), '|') AS itemset "
        "FROM fc, cm WHERE NOT list_contains(fc.items, cm.item)")
    o["j4_prefix_join_brands"] = _sql(
        _freq_ctes("brands", 0.5),
        "SELECT DISTINCT array_to_string([a.items[1], a.items[2], b.items[2]], '|') AS itemset "
        "FROM fa a JOIN fa b ON a.size = 2 AND b.size = 2 AND a.items[1] = b.items[1] AND a.items[2] < b.items[2]")
    cand_ctes = _freq_ctes("orders", 0.002, p="o") + [
        f"xb AS ({_baskets_sql('brands')})",
        "cnt AS (SELECT c.items, count(*) AS support FROM ofa c JOIN xb ON list_has_all(xb.items, c.items) "
        "GROUP BY c.items)"]
    o["j1_support_broadcast"] = _sql(cand_ctes, f"SELECT {_KEY} AS itemset, support FROM cnt")
    o["j2_support_index"] = o["j1_support_broadcast"]
    o["a3_itemset_support"] = _sql(
        _freq_ctes("brands", 0.5) + [
            f"xb AS ({_baskets_sql('brands')})",
            "cd AS (SELECT DISTINCT [a.items[1], a.items[2], b.items[2]] AS items FROM fa a JOIN fa b "
            "ON a.size = 2 AND b.size = 2 AND a.items[1] = b.items[1] AND a.items[2] < b.items[2])",
            "cnt AS (SELECT c.items, count(*) AS support FROM cd c JOIN xb ON list_has_all(xb.items, c.items) "
            "GROUP BY c.items)"],
        f"SELECT {_KEY} AS itemset, support, round(CAST(support AS DOUBLE) / (SELECT n FROM nb), 6) AS rel_support, "
        f"support >= (SELECT m FROM mc) AS is_frequent FROM cnt")
    o["a4_itemset_closure_lineitem"] = _sql(
        _freq_ctes("lineitem", 0.05) + [
            "pb AS (SELECT f.items, f.support, b.basket_id FROM fa f JOIN "
            "(SELECT basket_id, list(item) AS its FROM bi GROUP BY basket_id) b ON list_has_all(b.its, f.items))",
            "cc AS (SELECT pb.items, pb.support, x.item, count(*) AS c FROM pb JOIN bi x "
            "ON x.basket_id = pb.basket_id GROUP BY pb.items, pb.support, x.item)"],
        "SELECT array_to_string(items, '|') AS itemset, support, "
        "array_to_string(list_sort(list(item) FILTER (WHERE c = support)), '|') AS closure "
        "FROM cc GROUP BY items, support")
    o["a5_dataset_closure"] = _sql(
        _base_ctes("customer", 0.01) + ["x AS (SELECT item, count(*) AS c FROM bi GROUP BY item)"],
        "SELECT coalesce(array_to_string(list_sort(list(item)), '|'), '') AS closure FROM x "
        "WHERE c = (SELECT n FROM nb)")
    o["a5_f1_closure_of_containing"] = _sql(
        _base_ctes("customer", 0.01) + [
            "sel AS (SELECT basket_id FROM bi WHERE item = 'nat=NATION_7')",
            "x AS (SELECT item, count(*) AS c FROM bi WHERE basket_id IN (SELECT basket_id FROM sel) GROUP BY item)"],
        "SELECT array_to_string(list_sort(list(item)), '|') AS closure FROM x "
        "WHERE c = (SELECT count(*) FROM sel)")
    o["a6_grouped_closure_lineitem"] = _sql(
        [f"li AS (SELECT rid AS basket_id, s_nationkey AS grp, unnest(['flag=' || l_returnflag, "
         f"'status=' || l_linestatus, 'brand=' || p_brand, 'type=' || p_type, 'nat=' || n_name, "
         f"'reg=' || r_name]) AS item FROM {_LI_JOIN})",
         "sz AS (SELECT grp, count(DISTINCT basket_id) AS nb FROM li GROUP BY grp)",
         "co AS (SELECT grp, item, count(*) AS c FROM li GROUP BY grp, item)"],
        "SELECT sz.grp, CASE WHEN sz.grp <= 20 THEN coalesce(array_to_string(list_sort(list(co.item) "
        "FILTER (WHERE co.c = sz.nb)), '|'), '') ELSE '' END AS closure "
        "FROM sz LEFT JOIN co ON co.grp = sz.grp GROUP BY sz.grp, sz.nb")
    o["a7_frequent_among_customer"] = _sql(
        _base_ctes("customer", 0.01),
        "SELECT item, count(*) AS support FROM bi WHERE starts_with(item, 'nat=') GROUP BY item "
        "HAVING count(*) > CAST(0.04 AS DOUBLE) * (SELECT n FROM nb)")
    o["a1_item_support_words"] = _sql(
        _base_ctes("words", 0.35),
        "SELECT item, count(*) AS support FROM bi GROUP BY item HAVING count(*) >= (SELECT m FROM mc)")
    o["a2_distinct_items_lineitem"] = _sql(_base_ctes("lineitem", 0.01), "SELECT DISTINCT item FROM bi")
    o["a8_majority_items_customer"] = _sql(
        _base_ctes("customer", 0.1) + [f"fr AS {_customer_fraction_sql()}",
                                        f"ps AS ({_per_sample_counts_sql()})"],
        "SELECT item, count(DISTINCT sample) AS votes FROM ps "
        "WHERE support >= (SELECT t * f FROM fr) GROUP BY item HAVING count(DISTINCT sample) >= 2")
    o["a9_mean_item_support_customer"] = _sql(
        _base_ctes("customer", 0.1) + [f"fr AS {_customer_fraction_sql()}",
                                        f"ps AS ({_per_sample_counts_sql()})"],
        "SELECT item, round(avg(support), 6) AS mean_support, count(*) AS n_samples FROM ps GROUP BY item")
    o["a10_accuracy_words"] = _sql(
        _freq_ctes("words", 0.40, p="e") + [_closed_cte("e")] + _freq_ctes("words", 0.45, p="a") + [_closed_cte("a")] + [
            "cov AS (SELECT x.items, CASE WHEN EXISTS (SELECT 1 FROM afc y WHERE list_has_all(y.items, x.items)) "
            "THEN 1 ELSE 0 END AS c FROM efc x)",
            "rat AS (SELECT y.support / coalesce((SELECT min(x.support) FROM efc x WHERE x.items = y.items), "
            "(SELECT min(x.support) FROM efc x WHERE list_has_all(y.items, x.items))) AS r FROM afc y)"],
        "SELECT round((SELECT count(*) - sum(c) FROM cov) / (SELECT count(*) FROM cov), 6) AS not_identified, "
        "round((SELECT count(*) FROM afc) / (SELECT count(*) FROM efc), 6) AS approx_overhead, "
        "round((SELECT avg(r) FROM rat), 6) AS approx_alpha_mean")
    o["a11_max_local_support_words"] = _sql(
        _base_ctes("words", 0.45) + [
            f"ch AS (SELECT doc_id AS basket_id, {_md5_unit(repr('son:'), 'doc_id')} % 4 AS chunk FROM documents)",
            "sz AS (SELECT chunk, count(*) AS m FROM ch GROUP BY chunk)",
            "lc AS (SELECT ch.chunk, bi.item, count(*) AS c FROM bi JOIN ch ON ch.basket_id = bi.basket_id "
            "GROUP BY ch.chunk, bi.item)",
            "ls AS (SELECT lc.item, max(CAST(lc.c AS DOUBLE) / sz.m) AS s FROM lc JOIN sz ON sz.chunk = lc.chunk "
            "GROUP BY lc.item)"],
        "SELECT item AS itemset, round(s, 6) AS max_local_support FROM ls WHERE s >= 0.45 - 1e-12")
    o["a12_distinct_itemsets_words"] = _sql_closed("words", 0.40)
    o["a13_level_words"] = _sql(_freq_ctes("words", 0.40), f"SELECT {_KEY} AS itemset, support FROM fa WHERE size = 2")
    o["a13_level_union_words"] = _sql(
        _freq_ctes("words", 0.45), f"SELECT {_KEY} AS itemset, support, CAST(size AS INTEGER) AS level FROM fa "
                                   "WHERE size <= 3")
    o["f1_containing_brands"] = (
        f"SELECT basket_id, array_to_string(items, '|') AS itemset FROM ({_baskets_sql('brands')}) "
        f"WHERE list_has_all(items, ['Brand#13', 'Brand#21'])")
    o["f2_min_support_words"] = _sql(_freq_ctes("words", 0.45), 
        f"SELECT {_KEY} AS itemset, support FROM fa WHERE support > (SELECT ceil(0.5 * n - 1e-9) FROM nb)")
    o["f3_only_common_brands"] = _sql(
        _freq_ctes("brands", 0.5) + [
            "cm AS (SELECT item FROM bi GROUP BY item HAVING count(*) >= "
            "(SELECT CAST(ceil(0.6 * n - 1e-9) AS BIGINT) FROM nb))"],
        f"SELECT {_KEY} AS itemset, support FROM fa WHERE list_has_all((SELECT list(item) FROM cm), items)")
    o["f4_canonical_events"] = (
        f"SELECT array_to_string(items, '|') AS itemset, count(*) AS n_baskets FROM ({_baskets_sql('events')}) "
        f"GROUP BY 1")
    o["f5_explode_events"] = _sql(_base_ctes("events", 0.01), "SELECT basket_id, item FROM bi")
    o["f6_scale_support_customer"] = _sql(
        _base_ctes("customer", 0.01),
        f"SELECT item, CAST(floor(least(count(*) * {_d(1 / 0.3)}, (SELECT n FROM nb))) AS BIGINT) AS support FROM bi "
        f"WHERE {_md5_unit(repr('42:'), 'basket_id')} < 0.3 * 4294967296 GROUP BY item")
    o["p1_sample_customer"] = (
        f"SELECT basket_id, array_to_string(items, '|') AS itemset FROM ({_baskets_sql('customer')}) "
        f"WHERE {_md5_unit(repr('42:'), 'basket_id')} < 0.3 * 4294967296")
    ratios = ", ".join(repr(r) for r in SWEEP_RATIOS)
    o["p2_sample_plan"] = _sql(
        [f"nb AS ({SQL_BI['customer'][1]})",
         f"pr AS (SELECT n, unnest([{ratios}]) AS ratio FROM nb)",
         "pt AS (SELECT n, CAST(ratio AS DOUBLE) AS ratio, "
         "CAST(ceil(CAST(ratio AS DOUBLE) * n) AS DOUBLE) AS threshold FROM pr)",
         f"ps AS (SELECT n, ratio, threshold, CAST({_size_a('n', 'threshold')} AS BIGINT) AS sample_size FROM pt)"],
        f"SELECT n, round(ratio, 6) AS ratio, threshold, sample_size, "
        f"round(least({_d(1.0)}, sample_size / n), 6) AS fraction, "
        f"round(threshold * least({_d(1.0)}, sample_size / n), 6) AS scaled_threshold, "
        f"CAST(2 * ceil((ln({_d(1.0)} / {_d(0.1)}) * {_d(2.0)} * n) / ({_d(1.0 - 0.01)} * {_d(0.1 ** 2)} * threshold)) "
        f"AS BIGINT) AS sample_size_b, "
        f"round(({_d(2.0)} * n * ln({_d(1.0)} / {_d(0.1)})) / (threshold * {_d(0.1 ** 2)} * {_d(1.0 - 0.1)}), 6) "
        f"AS sample_size_c FROM ps")
    o["s3_document_words"] = (
        f"SELECT doc_id AS basket_id, len(its) AS n_items, array_to_string(its, '|') AS itemset FROM "
        f"(SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '{_WS}'), "
        f"lambda w: w <> ''))) AS its FROM documents)")
    o["s4_customer_baskets"] = (
        f"SELECT basket_id, array_to_string(items, '|') AS itemset FROM ({_baskets_sql('customer')})")
    o["s4_brands_per_customer"] = (
        f"SELECT basket_id, array_to_string(items, '|') AS itemset FROM ({_baskets_sql('brands')})")
    o["s4_event_baskets"] = (
        f"SELECT basket_id, array_to_string(items, '|') AS itemset FROM ({_baskets_sql('events')})")
    o["s5_s1_roundtrip_brands"] = (
        f"SELECT array_to_string(items, '|') AS itemset, count(*) AS n_baskets FROM ({_baskets_sql('brands')}) "
        f"GROUP BY 1")
    o["s5_s1_roundtrip_lineitem"] = (
        f"SELECT array_to_string(items, '|') AS itemset, count(*) AS n_baskets FROM ({_baskets_sql('lineitem')}) "
        f"GROUP BY 1")
    o["s1_bigint_parts"] = (
        "SELECT len(its) AS n_items, array_to_string(list_sort(its), '|') AS itemset, count(*) AS n_baskets "
        "FROM (SELECT list(DISTINCT l_partkey) AS its FROM lineitem GROUP BY l_orderkey) GROUP BY ALL")
    o["s1_line_ids_parts"] = (
        "SELECT row_number() OVER (ORDER BY l_orderkey) - 1 AS basket_id, array_to_string(list_sort(its), '|') AS itemset "
        "FROM (SELECT l_orderkey, list(DISTINCT l_partkey) AS its FROM lineitem GROUP BY l_orderkey)")
    o["p1_sample_text_brands"] = (
        f"SELECT basket_id, itemset FROM (SELECT row_number() OVER (ORDER BY basket_id) - 1 AS basket_id, "
        f"array_to_string(items, '|') AS itemset FROM ({_baskets_sql('brands')})) "
        f"WHERE {_md5_unit(repr('42:'), 'basket_id')} < 0.3 * 4294967296")
    o["s1_hashed_brands"] = _sql(
        _base_ctes("brands", 0.5), "SELECT item, count(*) AS support FROM bi GROUP BY item")
    o["s2_delimited_documents"] = (
        f"SELECT len(its) AS n_items, array_to_string(its, '|') AS itemset FROM "
        f"(SELECT list_sort(list_distinct(list_filter(regexp_split_to_array(text, '{_WS}'), "
        f"lambda w: w <> ''))) AS its FROM documents) WHERE len(its) > 0")
    labels = " UNION ALL ".join(f"SELECT '{k}' AS label, {v!r} AS f" for k, v in SIZE_FRACTIONS.items())
    o["s6_size_variants_customer"] = (
        f"SELECT l.label AS size_label, c.basket_id, array_to_string(c.items, '|') AS itemset FROM ({_baskets_sql('customer')}) c, ({labels}) l "
        f"WHERE {_md5_unit(repr('42:'), "l.label || ':' || CAST(c.basket_id AS VARCHAR)")} < l.f * 4294967296")
    o["m2_approx_closed_events"] = _sql_approx_small("events", 0.01, 0.1)
    o["m2_approx_closed_customer"] = _sql_approx_short("customer", 0.05, 0.1)
    o["m12_sweep_customer"] = _sql_sweep("customer", "threshold", "ratio", [0.05, 0.1])
    o["m12_sweep_alpha_customer"] = _sql_sweep("customer", "alpha", "alpha", SWEEP_STEPS[::2], SWEEP_BASE)
    o["m12_sweep_epsilon_customer"] = _sql_sweep("customer", "epsilon", "epsilon", SWEEP_STEPS[::2], SWEEP_BASE)
    o["m12_sweep_size_customer"] = _sql_sweep("customer", "size", "fraction",
                                              [SIZE_FRACTIONS[k] for k in SWEEP_LABELS[::2]], SWEEP_BASE)
    pivot = ", ".join(f"round(avg(CASE WHEN algorithm = '{a}' THEN value END), 6) AS {a}"
                      for a in ("exact", "fpgrowth", "sampled"))
    sw_ctes, sw_rows = _sweep_rows_sql("customer", "threshold", "ratio", [0.05, 0.1])
    o["m13_sweep_report_customer"] = _sql(
        sw_ctes, f"SELECT sweep, param_label, param_value, measure, {pivot} FROM ({sw_rows}) "
                 "GROUP BY sweep, param_label, param_value, measure")
    sw_ctes, sw_rows = _sweep_rows_sql("customer", "epsilon", "epsilon", SWEEP_STEPS, SWEEP_BASE)
    axis = ", ".join(f"({v!r}::DOUBLE, '{label}', {k})" for k, (v, label) in enumerate(zip(SWEEP_STEPS, SWEEP_LABELS), 1))
    o["m13_report_epsilon_customer"] = _sql(
        sw_ctes + [f"sw AS MATERIALIZED ({sw_rows})", f"ax(v, axis, place) AS (VALUES {axis})",
                   "flat AS (SELECT measure, algorithm, avg(value) AS value FROM sw GROUP BY ALL)"],
        "SELECT sweep, param_label, param_value, axis, CAST(place AS INTEGER) AS place, sw.measure, "
        + ", ".join(f"round((SELECT f.value FROM flat f WHERE f.measure = sw.measure AND f.algorithm = '{a}'), 6) AS {a}"
                    for a in ("exact", "fpgrowth"))
        + ", round(avg(CASE WHEN algorithm = 'sampled' THEN value END), 6) AS sampled "
          "FROM sw JOIN ax ON ax.v = sw.param_value GROUP BY ALL")
    o["s9_sweep_roundtrip_customer"] = _sql_sweep("customer", "threshold", "ratio", [0.1], algorithms=("exact",))
    o["s8_lattice_roundtrip_customer"] = _sql(
        _freq_ctes("customer", 0.01) + [
            _closed_cte(),
            "pr AS (SELECT a.items AS parent, b.items AS child FROM fc a JOIN fc b "
            "ON a.size < b.size AND list_has_all(b.items, a.items))",
            "tw AS (SELECT DISTINCT p1.parent, p2.child FROM pr p1 JOIN pr p2 ON p1.child = p2.parent)"],
        f"SELECT {_KEY} AS itemset, support, CAST(size AS INTEGER) AS level FROM fc UNION ALL "
        "SELECT array_to_string(parent, '|') || '>' || array_to_string(child, '|'), NULL, NULL FROM pr "
        "WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw.parent = pr.parent AND tw.child = pr.child)")
    return o


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query; only training-data queries that SQL cannot express
    have none (they are tested against brute force)."""
    o = _oracle() | (_TRAINING_DATA[1] if _TRAINING_DATA else {})
    return {k: v for k, v in o.items() if k in _QUERIES}
