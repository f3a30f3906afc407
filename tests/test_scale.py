"""Plans for large inputs give the rows of the small ones: chunks of codes, hot anchors,
bounded groups and chunks, one mining run for many thresholds."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from basket_helpers import as_dict, make_baskets
from basketry.operators import support
from basketry.operators.candidates import support_upper_bound
from basketry.operators.encoding import counted_items, encode
from basketry.operators.support import dataset_closure, itemset_closure, itemset_support, match_candidates
from basketry.plans import frequent
from basketry.plans.closed import closed_itemsets, closed_itemsets_naive, closed_lattice
from basketry.plans.evaluate import sweep, sweep_report
from basketry.plans.frequent import fp_groups, frequent_itemsets_fp, frequent_itemsets_son, local_supports
from basketry.plans.lattice import lattice_edges


def random_baskets(seed, n=60, items=9, most=6):
    rnd = random.Random(seed)
    return [sorted(rnd.sample(range(1, items + 1), rnd.randint(1, most))) for _ in range(n)]


def closures(baskets, least):
    """All closed sets with support >= least, by intersections."""
    found = set()
    for b in {frozenset(b) for b in baskets}:
        found |= {b & f for f in found} | {b}
    sup = {tuple(sorted(c)): sum(c <= set(b) for b in baskets) for c in found if c}
    return {c: s for c, s in sup.items() if s >= least}


def covers(nodes):
    pairs = {(a, b) for a in nodes for b in nodes if set(a) < set(b)}
    return {(a, b) for a, b in pairs if not any((a, c) in pairs and (c, b) in pairs for c in nodes)}


def edges_of(df):
    rows = [(tuple(r.parent), tuple(r.child)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_closed_lattice_against_brute_force(spark):
    baskets = random_baskets(1)
    nodes, edges = closed_lattice(make_baskets(spark, baskets), min_count=3)
    want = closures(baskets, 3)
    assert as_dict(nodes) == want and {r.level for r in nodes.collect()} == {len(c) for c in want}
    assert edges_of(edges) == covers(want)
    assert edges_of(lattice_edges(nodes, "cover")) == covers(want)
    nodes, edges = closed_lattice(make_baskets(spark, [[1], [2]]), min_count=5)
    assert nodes.count() == 0 and edges.count() == 0


def test_covers_of_a_family_without_intersections(spark):
    family = [(1,), (1, 2, 3), (1, 2, 4), (1, 2, 3, 4, 5), (6,), (1, 6, 7)]
    df = spark.createDataFrame([(list(x), 1) for x in family], "items array<long>, support long")
    assert edges_of(lattice_edges(df, "cover")) == covers(family)


@pytest.mark.parametrize("chunk", [2, 1024])
def test_closures_in_chunks_of_codes(spark, monkeypatch, chunk):
    monkeypatch.setattr(support, "CODES_PER_ROW", chunk)
    baskets = random_baskets(2) + [[1, 2, 3, 4, 5, 6, 7, 8, 9]]
    b, want = make_baskets(spark, baskets), closures(baskets, 4)
    assert as_dict(closed_itemsets(b, min_count=4)) == want
    assert as_dict(closed_itemsets_naive(b, min_count=4)) == want
    _, edges = closed_lattice(b, min_count=4)
    assert edges_of(edges) == covers(want)
    given = [(1,), (2, 5), (3, 4, 6), (1, 2, 3, 4, 5, 6, 7, 8, 9)]
    got = itemset_closure(b, spark.createDataFrame([(list(x),) for x in given], "items array<long>"))
    for r in got.collect():
        holders = [set(x) for x in baskets if set(r["items"]) <= set(x)]
        assert (r.support, r.closure) == (len(holders), sorted(set.intersection(*holders)))
    enc = encode(b, 4)
    rows = support.closure_parts(enc, enc.codes.select(F.array("code").alias("cand")), enc.n_codes, ext_min=4).collect()
    assert max(len(r.closure) + len(r.ext) for r in rows) <= chunk


@pytest.mark.parametrize("hot", [0, 10 ** 9])
def test_index_match_with_hot_and_cold_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(support, "HOT_PAIRS", hot)
    baskets = random_baskets(3, n=40)
    given = [c for k in (1, 2, 3, 4) for c in combinations(range(1, 10), k)]
    cands = spark.createDataFrame([(list(c),) for c in given], "items array<long>")
    pairs = [(tuple(r["items"]), r.basket_id) for r in match_candidates(make_baskets(spark, baskets), cands, "index").collect()]
    want = [(c, i) for i, x in enumerate(baskets) for c in given if set(c) <= set(x)]
    assert sorted(pairs) == sorted(want)
    sup = as_dict(itemset_support(make_baskets(spark, baskets), cands, strategy="index"))
    assert sup == {c: sum(c == d for d, _ in want) for c in {c for c, _ in want}}


def test_candidates_too_large_to_broadcast(spark, monkeypatch):
    baskets = make_baskets(spark, random_baskets(4))
    cands = spark.createDataFrame([([1, 2],), ([3],)], "items array<long>")
    small = sorted(map(str, match_candidates(baskets, cands, "broadcast").collect()))
    monkeypatch.setattr(support, "BROADCAST_BYTES", 1)
    df = match_candidates(baskets, cands, "broadcast")
    assert sorted(map(str, df.collect())) == small


@pytest.mark.parametrize("group_rows", [1, 5, 20_000])
def test_upper_bound_by_tries_against_brute_force(spark, group_rows):
    rnd = random.Random(5)
    known = [(sorted(rnd.sample("abcdefgh", rnd.randint(1, 4))), rnd.randint(1, 50)) for _ in range(40)]
    known += [(["a"], 60), (["a"], 55)]
    sets = [sorted(rnd.sample("abcdefghxyz", rnd.randint(1, 7))) for _ in range(60)]
    rows = [(x, i) for i, x in enumerate(sets + sets[:3])]
    got = support_upper_bound(spark.createDataFrame(rows, "items array<string>, support long"),
                              spark.createDataFrame(known, "items array<string>, support long"), group_rows)
    assert got.columns == ["items", "support", "bound"]
    assert sorted((r.support, r.bound or 0) for r in got.collect()) == [
        (i, min((s for k, s in known if set(k) <= set(x)), default=0)) for x, i in rows]


def test_baskets_and_items_are_counted_in_one_pass(spark):
    rows = [(1, ["a", "a", None]), (1, []), (2, None), (3, ["a", "b"])]
    df = spark.createDataFrame(rows, "basket_id long, items array<string>")
    assert {r["item"]: r.support for r in counted_items(df).collect()} == {None: 4, "a": 2, "b": 1}
    assert encode(df, min_ratio=0.5).min_count == 2 and encode(df, 1).n == 4
    assert dataset_closure(df.where("basket_id = 3")).first().closure == ["a", "b"]
    assert dataset_closure(df.limit(0)).first().closure == []


def test_only_small_inputs_are_kept(spark, monkeypatch, tmp_out):
    from basketry import session
    make_baskets(spark, random_baskets(8)).write.parquet(f"{tmp_out}/b")
    df = spark.read.parquet(f"{tmp_out}/b")
    assert 0 < session.scanned_bytes(df) < 1 << 20
    with session.persisted(df) as kept:
        assert kept.storageLevel.useMemory
        small = as_dict(closed_itemsets(df, min_count=5))
    monkeypatch.setattr(session, "PERSIST_BYTES", 10)
    with session.persisted(df) as kept:
        assert not kept.storageLevel.useMemory and not kept.storageLevel.useDisk
    assert as_dict(closed_itemsets(df, min_count=5)) == small


def test_fp_groups_follow_the_histogram():
    assert fp_groups(items=5, slots=100, most=50, parallelism=8) == 5
    assert fp_groups(items=900, slots=100, most=50, parallelism=8) == 8
    assert fp_groups(items=900, slots=500_000_000, most=1_000, parallelism=8) == 500
    assert fp_groups(items=900, slots=500_000_000, most=250_000_000, parallelism=8) == 8
    assert fp_groups(items=1, slots=0, most=0, parallelism=8) == 1


def test_son_chunks_by_bytes_and_partitions(spark):
    baskets = random_baskets(6, n=400, items=7)
    b = make_baskets(spark, baskets).repartition(8)
    want = as_dict(frequent_itemsets_fp(b, min_ratio=0.2))
    assert as_dict(frequent_itemsets_son(b, 0.2, chunk_rows=25)) == want
    assert local_supports(b, 0.2, 50, 400).rdd.getNumPartitions() == 8
    # nearly empty partitions are read together
    assert local_supports(b, 0.2, 200_000, 400).rdd.getNumPartitions() == 1
    # chunks of a few bytes: everything that is frequent anywhere is found
    local = local_supports(b, 0.2, 200_000, 400, chunk_bytes=2_000)
    assert set(want) <= {tuple(r["items"]) for r in local.select("items").distinct().collect()}


def test_sweep_mines_once_and_the_report_has_order_and_baseline(spark, monkeypatch):
    from basketry.plans import closed
    calls, mine = [], closed.closed_itemsets
    monkeypatch.setattr(closed, "closed_itemsets", lambda *a, **k: calls.append(k["min_count"]) or mine(*a, **k))
    baskets = random_baskets(7, n=100)
    r = sweep(spark, make_baskets(spark, baskets), "threshold", "ratio", [0.3, 0.1, 0.2], algorithms=("exact", "fpgrowth"))
    assert calls == [10]
    rows = {(x.param_value, x.algorithm, x.measure): x.value for x in r.collect()}
    for v in (0.1, 0.2, 0.3):
        assert rows[v, "exact", "num_cis"] == len(closures(baskets, round(100 * v)))
        assert rows[v, "fpgrowth", "not_identified"] == 0
        assert rows[v, "fpgrowth", "time"] >= max(rows[v, "fpgrowth", "sets_time"], rows[v, "fpgrowth", "closed_time"])
    rep = sweep_report(r, axis={0.3: "high", 0.1: "low"}, flat=("exact",)).where("measure = 'num_cis'").orderBy("place").collect()
    mean = sum(rows[v, "exact", "num_cis"] for v in (0.1, 0.2, 0.3)) / 3
    assert [(x.axis, x.place, x.param_value) for x in rep] == [("high", 1, 0.3), ("low", 2, 0.1)]
    assert all(abs(x.exact - mean) < 1e-9 for x in rep)
    assert sweep_report(r).where("measure = 'num_cis'").count() == 3


@pytest.mark.parametrize("extra", [0, 300])
def test_grown_itemsets_against_fp_growth_and_brute_force(spark, monkeypatch, extra):
    """Dense baskets go to folded conditional bases, which MLlib's trees never see; 300 more items
    (in pairs of baskets) are beyond the codes looked up in a literal map."""
    rnd = random.Random(12)
    baskets = [sorted(rnd.sample(range(1, 10), rnd.randint(3, 8))) for _ in range(60)] + [[5], [], [1, 1, 2]]
    baskets += [[10 + k] for k in range(extra) for _ in range(2)]
    b = make_baskets(spark, baskets)
    for least in (2, 20, 900):
        plain = as_dict(frequent_itemsets_fp(b, min_count=least, num_partitions=2))
        with monkeypatch.context() as m:
            m.setattr(frequent, "TREE_PLACES", 0)
            m.setattr(frequent, "FPGrowth", None)
            rows = [(tuple(r["items"]), r["support"], r["size"]) for r in frequent_itemsets_fp(b, min_count=least).collect()]
        assert len(rows) == len(set(rows)) and {i: s for i, s, _ in rows} == plain
        assert all(len(i) == n for i, _, n in rows)
        held = {c: sum(set(c) <= set(x) for x in baskets) for n in (1, 2, 3) for c in combinations(range(1, 10), n)}
        assert {i: s for i, s, n in rows if n <= 3 and max(i) < 10} == {c: s for c, s in held.items() if s >= least}


@pytest.mark.parametrize("items", [9, 80])
def test_matches_by_bits(spark, monkeypatch, items):
    """Up to 63 codes the bits decide, beyond that they only part pairs; hot anchors are dealt to parts,
    and with few codes no pair is joined with its basket again."""
    monkeypatch.setattr(support, "HOT_PAIRS", 20)
    monkeypatch.setattr(support, "PART_ROWS", 5)
    baskets = random_baskets(21, n=70, items=items, most=min(items, 30))
    cands = [c for n in (1, 2, 3) for c in combinations(range(1, 8), n)] + [(k,) for k in range(1, items + 1)] + [(1, items)]
    df = spark.createDataFrame([(list(c),) for c in set(cands)], "items array<long>")
    want = sorted((c, i) for i, x in enumerate(baskets) for c in set(cands) if set(c) <= set(x))
    if items <= support.MASK_CODES:
        monkeypatch.setattr(support, "match_rows", None)
    for strategy in ("broadcast", "index"):
        got = match_candidates(make_baskets(spark, baskets), df, strategy=strategy)
        assert sorted((tuple(r["items"]), r["basket_id"]) for r in got.collect()) == want
