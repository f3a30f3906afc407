"""Support, closure, joins, filters, sampling, lattice and evaluation operators."""

from basketry.functions.itemsets import min_count_for
from basketry.operators import filters as FL
from basketry.operators.candidates import (expand_level, itemset_difference, prefix_join,
                                           support_upper_bound)
from basketry.operators.encoding import distinct_items, item_support
from basketry.operators.sampling import sample_baskets, sample_fraction, sample_plan, size_variants
from basketry.operators.support import (dataset_closure, frequent_among, grouped_closure,
                                        itemset_closure, itemset_support, match_candidates)
from basketry.plans.approx import approx_closed_itemsets, majority_items
from basketry.plans.closed import closed_itemsets
from basketry.plans.evaluate import accuracy
from basketry.plans.frequent import frequent_itemsets_fp
from basketry.plans.lattice import itemset_lattice, level, reachable_itemsets
from basket_helpers import as_dict, digits, make_baskets

F5 = [digits(x) for x in "1234 123 34 12 124".split()]
FCL = [{1, 2, 3, 4}, {1, 2, 4, 5, 6}, {1, 2, 3, 4, 5, 6, 10, 123}, {1, 2, 4, 5, 11, 12, 13, 14, 15, 16}]
FAP = [digits(x) for x in "12346 23456 12356 12456".split()]


def itemsets(spark, sets):
    return spark.createDataFrame([(sorted(s),) for s in sets], "items array<long>")


def test_dataset_closure_fcl(spark):
    b = make_baskets(spark, FCL)
    assert list(dataset_closure(b).first().closure) == [1, 2, 4]


def test_itemset_closure_and_idempotence(spark):
    b = make_baskets(spark, F5)
    c = itemset_closure(b, itemsets(spark, [{1}, {3}, {3, 4}, {9}])).collect()
    got = {tuple(r["items"]): (r.support, tuple(r.closure)) for r in c}
    assert got == {(1,): (4, (1, 2)), (3,): (3, (3,)), (3, 4): (2, (3, 4))}
    again = itemset_closure(b, itemsets(spark, [set(v[1]) for v in got.values()])).collect()
    assert all(tuple(r["items"]) == tuple(r.closure) for r in again)


def test_j1_equals_j2(spark):
    b = make_baskets(spark, FAP * 2)
    cands = itemsets(spark, [{2, 6}, {1, 2, 6}, {3, 5}, {1, 4, 5}, {7}])
    j1 = sorted((tuple(r["items"]), r.basket_id) for r in match_candidates(b, cands, "broadcast").collect())
    j2 = sorted((tuple(r["items"]), r.basket_id) for r in match_candidates(b, cands, "index").collect())
    assert j1 == j2 and len(j1) == 8 + 6 + 4 + 2


def test_itemset_support_apriori_form(spark):
    b = make_baskets(spark, FAP)
    s = itemset_support(b, itemsets(spark, [{2, 6}, {1, 3}, {7}]), n=4, min_count=3).collect()
    got = {tuple(r["items"]): (r.support, r.rel_support, r.is_frequent) for r in s}
    assert got == {(2, 6): (4, 1.0, True), (1, 3): (2, 0.5, False)}


def test_grouped_closure(spark):
    rows = [(0, [1, 2, 3], 1), (1, [1, 2], 1), (2, [5, 6], 2), (3, [5, 7], 2), (4, [8], 30)]
    b = spark.createDataFrame(rows, "basket_id long, items array<long>, grp long")
    got = {r.grp: list(r.closure) for r in grouped_closure(b, "grp", max_group=20).collect()}
    assert got == {1: [1, 2], 2: [5], 30: []}
    got = {r.grp: list(r.closure) for r in grouped_closure(b, "grp", within=[2, 5]).collect()}
    assert got == {1: [2], 2: [5], 30: []}


def test_frequent_among_is_strict(spark):
    b = make_baskets(spark, F5)
    listed = spark.createDataFrame([(1,), (3,), (4,)], "item long")
    got = {r.item: r.support for r in frequent_among(b, listed, 3).collect()}
    assert got == {1: 4}


def test_filters(spark):
    b = make_baskets(spark, F5)
    assert FL.containing(b, [1, 2]).count() == 4
    assert FL.containing(b, [4]).count() == 3
    sup = item_support(b)
    assert {r.item for r in FL.min_support(sup, min_ratio=0.7, n=5).collect()} == {1, 2}
    assert {r.item for r in FL.min_support(sup, min_count=3, strict=True).collect()} == {1, 2}
    f = frequent_itemsets_fp(b, min_count=2)
    common = spark.createDataFrame([(1,), (2,)], "item long")
    assert set(as_dict(FL.only_common(f, common))) == {(1,), (2,), (1, 2)}
    s = FL.scale_support(sup, 2.5, 9).collect()
    assert {r.item: r.support for r in s} == {1: 9, 2: 9, 3: 7, 4: 7}
    assert FL.explode_items(b).count() == 14
    assert sorted(r.item for r in distinct_items(b).collect()) == [1, 2, 3, 4]


def test_candidates(spark):
    lvl = itemsets(spark, [{1, 2}, {1, 3}, {1, 4}, {2, 3}])
    got = {tuple(r["items"]) for r in prefix_join(lvl).collect()}
    assert got == {(1, 2, 3), (1, 2, 4), (1, 3, 4)}
    common = spark.createDataFrame([(1,), (2,), (3,)], "item long")
    got = {tuple(r["items"]) for r in expand_level(itemsets(spark, [{1}, {2, 3}]), common).collect()}
    assert got == {(1, 2), (1, 3), (1, 2, 3)}
    x = spark.createDataFrame([([1], 1), ([1], 1), ([2], 2)], "items array<long>, support long")
    y = itemsets(spark, [{2}])
    assert itemset_difference(x, y).count() == 2
    known = spark.createDataFrame([([1], 5), ([1, 2], 3), ([3], 9)], "items array<long>, support long")
    h = spark.createDataFrame([([1, 2, 4], 1), ([3, 4], 1), ([4], 1)], "items array<long>, support long")
    got = {tuple(r["items"]): r.bound for r in support_upper_bound(h, known).collect()}
    assert got == {(1, 2, 4): 3, (3, 4): 9, (4,): None}


def test_sampling_plan_and_md5(spark):
    import math
    want = math.ceil(5 * (math.log(1000) * 2 * 5_000_000) / (0.9 ** 2 * 400_000))
    assert sample_fraction(5_000_000, 400_000, 0.001)[0] == want
    params = spark.createDataFrame([(1000, 700.0, 0.1, 0.1)], "n long, threshold double, epsilon double, alpha double")
    r = sample_plan(params).first()
    assert r.sample_size == 41 and abs(r.fraction - 0.041) < 1e-12
    b = make_baskets(spark, [[i % 7, i % 5] for i in range(400)])
    s1 = {r.basket_id for r in sample_baskets(b, 0.3, seed=42).collect()}
    s2 = {r.basket_id for r in sample_baskets(b.repartition(5), 0.3, seed=42).collect()}
    assert s1 == s2 and 80 < len(s1) < 160
    v = size_variants(b, {"a": 0.5, "b": 1.0}).groupBy("size_label").count().collect()
    assert {r.size_label: r["count"] for r in v}["b"] == 400


def test_approx_with_full_fraction_equals_exact(spark):
    # threshold so small relative to n that the sample size exceeds n: fraction 1
    b = make_baskets(spark, FAP * 5)
    a = approx_closed_itemsets(b, threshold=15, eps=0.1)
    exact = closed_itemsets(b, min_count=15)
    assert {k: v for k, v in as_dict(a).items()} == as_dict(exact)
    assert all(r.meets_threshold for r in a.collect())
    assert {r.item for r in majority_items(b, 1.0, 15).collect()} == {1, 2, 3, 4, 5, 6}


def test_accuracy(spark):
    ex = spark.createDataFrame([([1], 4), ([1, 2], 3), ([3], 2)], "items array<long>, support long")
    ap = spark.createDataFrame([([1, 2], 3), ([1, 4], 2)], "items array<long>, support long")
    r = accuracy(ap, ex).first()
    assert abs(r.not_identified - 1 / 3) < 1e-12
    assert abs(r.approx_overhead - 2 / 3) < 1e-12
    assert abs(r.approx_alpha_mean - (1.0 + 2 / 4) / 2) < 1e-12


def test_lattice_levels_and_reachability(spark):
    b = make_baskets(spark, FAP)
    f = frequent_itemsets_fp(b, min_count=3)
    nodes, edges = itemset_lattice(f)
    assert level(nodes, 1).count() == 6
    try:
        level(nodes, 9)
        assert False
    except IndexError:
        pass
    r = reachable_itemsets(nodes, edges)
    assert r.count() == 19
    cl = closed_itemsets(b, min_count=3)
    _, cover = itemset_lattice(cl, relation="cover")
    got = {(tuple(x.parent), tuple(x.child)) for x in cover.collect()}
    assert got == {((2, 6), (1, 2, 6)), ((2, 6), (2, 3, 6)), ((2, 6), (2, 4, 6)), ((2, 6), (2, 5, 6))}


def test_min_count_for():
    assert min_count_for(0.7, 10) == 7
    assert min_count_for(0.07, 100) == 7
    assert min_count_for(0.41, 5) == 3


def test_level_union_distinct_and_size_variant_sink(spark, tmp_out):
    import os
    from basketry.operators.sampling import write_size_variants
    from basketry.plans.lattice import distinct_itemsets, level_union
    a = spark.createDataFrame([([1], 4), ([2], 3)], "items array<long>, support long")
    b = spark.createDataFrame([([1, 2], 3), ([1], 2)], "items array<long>, support long")
    u = level_union([a, b])
    assert sorted((tuple(r["items"]), r.level) for r in u.collect()) == [((1,), 1), ((1,), 2), ((1, 2), 2), ((2,), 1)]
    assert as_dict(distinct_itemsets(u)) == {(1,): 4, (2,): 3, (1, 2): 3}
    bk = make_baskets(spark, [[i] for i in range(50)])
    path = os.path.join(tmp_out, "variants")
    write_size_variants(size_variants(bk, {"half": 0.5, "all": 1.0}), path)
    back = spark.read.parquet(path)
    assert back.where("size_label = 'all'").count() == 50
