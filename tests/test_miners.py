"""Goldens of FIXTURES.md (brute force) and agreement between the miners."""

from itertools import combinations

import pytest
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st

from basketry.plans.closed import closed_itemsets, closed_itemsets_fp, closed_itemsets_naive
from basketry.plans.frequent import (frequent_itemsets_apriori, frequent_itemsets_fp,
                                     frequent_itemsets_son)
from basketry.plans.rules import association_rules
from basketry.operators.candidates import closed_only, expand_subsets
from basket_helpers import as_dict, digits, make_baskets

F5 = [digits(x) for x in "1234 123 34 12 124".split()]
FM = [digits(x) for x in "1234 123 34 1 24".split()]
FAP = [digits(x) for x in "12346 23456 12356 12456".split()]


def golden(s):
    """'12:4 3:3' -> {(1, 2): 4, (3,): 3}"""
    out = {}
    for tok in s.split():
        k, v = tok.split(":")
        out[digits(k)] = int(v)
    return out


def brute(baskets, min_count):
    items = sorted({i for b in baskets for i in b})
    freq = {}
    for k in range(1, len(items) + 1):
        for c in combinations(items, k):
            s = sum(1 for b in baskets if set(c) <= set(b))
            if s >= min_count:
                freq[c] = s
    closed = {c: s for c, s in freq.items()
              if not any(set(c) < set(d) and t == s for d, t in freq.items())}
    return freq, closed


def all_closed(spark, b, mc):
    return [as_dict(closed_itemsets(b, min_count=mc)),
            as_dict(closed_itemsets_naive(b, min_count=mc)),
            as_dict(closed_itemsets_fp(b, min_count=mc))]


def test_f5_min_count_2(spark):
    b = make_baskets(spark, F5)
    for got in all_closed(spark, b, 2):
        assert got == golden("12:4 3:3 4:3 34:2 123:2 124:2")
    assert len(as_dict(frequent_itemsets_fp(b, min_count=2))) == 12
    ap = frequent_itemsets_apriori(b, min_count=2)
    assert as_dict(ap.where("is_frequent")) == as_dict(frequent_itemsets_fp(b, min_count=2))


def test_f5_ratio_041_gives_min_count_3(spark):
    b = make_baskets(spark, F5)
    assert len(as_dict(frequent_itemsets_fp(b, min_ratio=0.41))) == 5
    assert len(as_dict(frequent_itemsets_son(b, min_ratio=0.41, chunk_rows=3))) == 5


def test_f5_rules(spark):
    b = make_baskets(spark, F5)
    r = association_rules(frequent_itemsets_fp(b, min_count=2), 0.7).collect()
    got = {(tuple(x.antecedent), tuple(x.consequent)): x.confidence for x in r}
    want = {(digits(a), digits(c)) for a, c in
            [("2", "1"), ("1", "2"), ("23", "1"), ("13", "2"), ("24", "1"), ("14", "2")]}
    assert set(got) == want
    assert all(v == 1.0 for v in got.values())


@pytest.mark.parametrize("mc,n_freq,closed", [
    (1, 15, "1:3 2:3 3:3 4:3 24:2 34:2 123:2 1234:1"),
    (2, 10, "1:3 2:3 3:3 4:3 24:2 34:2 123:2"),
])
def test_fm_one_copy(spark, mc, n_freq, closed):
    b = make_baskets(spark, FM)
    for got in all_closed(spark, b, mc):
        assert got == golden(closed)
    assert len(as_dict(frequent_itemsets_fp(b, min_count=mc))) == n_freq


def test_fm_repeated_multiplies_supports(spark):
    k = 200
    b = make_baskets(spark, FM * k)
    got = as_dict(closed_itemsets(b, min_count=2 * k))
    assert got == {s: v * k for s, v in golden("1:3 2:3 3:3 4:3 24:2 34:2 123:2").items()}


def test_fap_frequent_closed_and_rules(spark):
    b = make_baskets(spark, FAP)
    freq = frequent_itemsets_fp(b, min_ratio=0.7)
    assert len(as_dict(freq)) == 19
    for got in all_closed(spark, b, 3):
        assert got == golden("26:4 126:3 236:3 246:3 256:3")
    rules = association_rules(freq, 0.7).collect()
    assert len(rules) == 42
    assert sum(1 for r in rules if len(r.consequent) == 2) == 12
    assert {round(r.confidence, 6) for r in rules} <= {0.75, 1.0}
    ap = frequent_itemsets_apriori(b, min_ratio=0.7)
    assert as_dict(ap.where("is_frequent")) == as_dict(freq)
    assert as_dict(frequent_itemsets_son(b, min_ratio=0.7, chunk_rows=2)) == as_dict(freq)


def test_expand_subsets_of_closed_gives_frequent(spark):
    b = make_baskets(spark, FAP)
    closed = closed_itemsets(b, min_count=3)
    assert as_dict(expand_subsets(closed)) == as_dict(frequent_itemsets_fp(b, min_count=3))


def test_closed_only_equals_closure_jump(spark):
    b = make_baskets(spark, F5 + FAP)
    f = frequent_itemsets_fp(b, min_count=2)
    assert as_dict(closed_only(f)) == as_dict(closed_itemsets(b, min_count=2))


def test_unchanged_under_repartition(spark):
    b = make_baskets(spark, FAP * 3 + F5 * 2)
    a = as_dict(closed_itemsets(b, min_count=4))
    c = as_dict(closed_itemsets(b.repartition(7), min_count=4))
    assert a == c


def test_string_items(spark):
    b = make_baskets(spark, [[str(i) for i in x] for x in F5], item_type="string")
    got = as_dict(closed_itemsets(b, min_count=2))
    assert got == {tuple(str(i) for i in k): v for k, v in golden("12:4 3:3 4:3 34:2 123:2 124:2").items()}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(1, 7), min_size=0, max_size=6), min_size=1, max_size=14),
       st.integers(1, 4))
def test_against_brute_force(spark, baskets, mc):
    b = make_baskets(spark, baskets)
    freq, closed = brute([set(x) for x in baskets], mc)
    assert as_dict(frequent_itemsets_fp(b, min_count=mc)) == freq
    assert as_dict(closed_itemsets(b, min_count=mc)) == closed
    assert as_dict(closed_itemsets_naive(b, min_count=mc)) == closed


def test_hot_item_and_hot_duplicate_basket(spark):
    """One item in every basket and a third of all baskets identical: the
    shuffle strategy (J2, AQE skew split) and the broadcast one agree with
    FP-growth and brute force."""
    import random
    rnd = random.Random(3)
    hot = [0, 1, 2, 3]
    baskets = [hot] * 300 + [[0] + rnd.sample(range(1, 12), rnd.randint(1, 5)) for _ in range(600)]
    b = make_baskets(spark, baskets)
    freq, closed = brute([set(x) for x in baskets], 60)
    assert as_dict(frequent_itemsets_fp(b, min_count=60)) == freq
    assert as_dict(closed_itemsets(b, min_count=60)) == closed
    assert as_dict(closed_itemsets(b, min_count=60, strategy="shuffle")) == closed
    assert as_dict(closed_itemsets_naive(b, min_count=60, strategy="shuffle")) == closed


def test_wide_universe_paths(spark):
    """More than 64 frequent items: join-based encoding and the restricted
    probe; all closed miners agree."""
    import random
    rnd = random.Random(11)
    baskets = [rnd.sample(range(100), 20) for _ in range(200)] + [list(range(0, 100, 2))] * 25
    b = make_baskets(spark, baskets)
    fp = as_dict(closed_itemsets_fp(b, min_count=30))
    assert len({k[0] for k in fp}) > 64
    assert as_dict(closed_itemsets(b, min_count=30)) == fp
    assert as_dict(closed_itemsets_naive(b, min_count=30)) == fp
