"""No caps and no size switches: the same answer on either side of every plan
choice, itemsets of any size, empty chunks and empty results."""

import subprocess
import sys
import tempfile
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketry.operators.candidates import closed_only_any, expand_level, expand_subsets
from basketry.operators.encoding import encode, item_codes
from basketry.operators.support import grouped_closure, itemset_support
from basketry.plans.closed import closed_itemsets, closed_itemsets_naive
from basketry.plans.evaluate import accuracy
from basketry.plans.frequent import frequent_itemsets_apriori, frequent_itemsets_son, local_supports
from basketry.plans.rules import association_rules
from basketry.sources.baskets import read_baskets, write_baskets
from basket_helpers import as_dict

REPO = str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("width", [256, 257])
def test_repeated_ids_and_items_give_one_answer(spark, width):
    """Three rows, two with the same id and one with a repeated item."""
    wide = list(range(width))
    rows = [(1, wide + [0, 0]), (1, wide), (2, [0, 0])]
    b = spark.createDataFrame(rows, "basket_id long, items array<long>")
    want = {tuple(wide): 2, (0,): 3}
    assert as_dict(closed_itemsets(b, min_count=2)) == want
    sup = itemset_support(b, spark.createDataFrame([(wide,), ([0],)], "items array<long>"))
    assert as_dict(sup) == want
    small = spark.createDataFrame([(i, x[:3] if len(x) > 3 else x) for i, x in rows], b.schema)
    assert as_dict(closed_itemsets_naive(small, min_count=2)) == {(0, 1, 2): 2, (0,): 3}
    assert as_dict(frequent_itemsets_son(small, 0.6, chunk_rows=1)) == as_dict(
        frequent_itemsets_apriori(small, min_count=2).where("is_frequent"))


def test_codes_are_dense_and_ordered_over_many_partitions(spark):
    items = spark.range(1000).select(F.concat(F.lit("i"), "id").alias("item"), (F.col("id") % 7).alias("support"))
    rows = item_codes(items.repartition(9)).collect()
    assert [r.code for r in sorted(rows, key=lambda r: (r.support, r.item))] == list(range(1000))
    enc = encode(spark.createDataFrame([(1, ["a", "b"]), (2, ["b"])], "basket_id long, items array<string>"), 1)
    assert dict(enc.codes.dtypes)["code"] == "bigint"


def test_large_itemsets_are_neither_cut_nor_refused(spark):
    big = [f"i{k:02d}" for k in range(70)]
    df = spark.createDataFrame([(big, 5)], "items array<string>, support long")
    sizes = Counter(map(len, as_dict(expand_subsets(df, smallest=68))))
    assert sizes == {70: 1, 69: 70, 68: 70 * 69 // 2}
    df = spark.createDataFrame([(big[:64], 7)], df.schema)
    assert Counter(map(len, as_dict(expand_subsets(df, smallest=63)))) == {64: 1, 63: 64}
    family = [(big, 5)] + [([x], 6) for x in big] + [(big[:k] + big[k + 1:], 5) for k in range(70)]
    rules = association_rules(spark.createDataFrame(family, "items array<string>, support long"), 0.8).collect()
    # 70-item sets: each single consequent; 69-item sets have no rule in this family
    assert len(rules) == 70 and all(len(r.antecedent) == 69 and r.confidence == 1.0 for r in rules)


def test_own_sets_stay_out_of_the_proper_subsets(spark):
    df = spark.createDataFrame([(["a", "b"], 2), (["a"], 3), (["c"], 1)], "items array<string>, support long")
    assert as_dict(expand_subsets(df, include_self=False)) == {("a",): 3, ("b",): 2}
    assert expand_subsets(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind, items", [("long", [[1, 2], [1, 2], [3], [4], [5], [6]]),
                                         ("string", [["a", "b"], ["a", "b"], ["c"], ["d"], [], ["f"]])])
def test_son_with_empty_chunks_and_impossible_ratio(spark, kind, items):
    b = spark.createDataFrame(list(enumerate(items)), f"basket_id long, items array<{kind}>").repartition(3)
    apart = spark.createDataFrame([(9, [])], b.schema)
    assert local_supports(apart, 0.5, 1, 1).count() == 0
    assert frequent_itemsets_son(b, 1.5, chunk_rows=2).count() == 0
    got = as_dict(frequent_itemsets_son(b, 0.3, chunk_rows=2))
    assert got == {tuple(items[0]): 2, (items[0][0],): 2, (items[0][1],): 2}


def test_son_runs_where_workers_lack_the_package():
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from basketry.plans.frequent import frequent_itemsets_son
b = spark.createDataFrame([(1, [1, 2]), (2, [1, 2])], "basket_id long, items array<long>")
print("rows", frequent_itemsets_son(b, 1.0, chunk_rows=1).count())
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="basketry-test-"), env=env,
                         capture_output=True, text=True, timeout=240)
    assert "rows 3" in out.stdout, out.stderr[-2000:]


def test_accuracy_without_exact_sets_is_null(spark):
    some = spark.createDataFrame([(["a"], 2)], "items array<string>, support long")
    got = accuracy(some, some.limit(0)).first()
    assert got.not_identified is None and got.approx_overhead is None and got.approx_alpha_mean is None
    assert accuracy(some.limit(0), some).first().not_identified == 1.0


def test_closed_filter_of_an_arbitrary_list(spark):
    rows = [(["a"], 2), (["a", "b", "c"], 2), (["b"], 3), (["a", "c"], 3), (["c"], 3)]
    df = spark.createDataFrame(rows, "items array<string>, support long")
    assert as_dict(closed_only_any(df)) == {("a", "b", "c"): 2, ("b",): 3, ("a", "c"): 3}


def test_expand_level_with_many_common_items(spark):
    level = spark.createDataFrame([(["x0000"],), (["y"],)], "items array<string>")
    common = spark.range(2500).select(F.format_string("x%04d", "id").alias("item"))
    assert expand_level(level, common).count() == 2499 + 2500


def test_items_with_separators_survive_the_round_trip(spark, tmp_out):
    baskets = [["type=A B", "z", "100%", "50%20off"], ["a\nb", "c\r"], ["é x"]]
    b = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(baskets)], "basket_id long, items array<string>")
    write_baskets(b, f"{tmp_out}/b")
    back = read_baskets(spark, f"{tmp_out}/b", escaped=True)
    assert sorted(r["items"] for r in back.collect()) == sorted(sorted(x) for x in baskets)


def test_grouped_closure_in_one_aggregate_per_group(spark):
    rows = [(1, ["a", "b"]), (1, ["a", "c", "a"]), (2, ["d"]), (3, []), (None, ["e"])]
    df = spark.createDataFrame(rows, "grp long, items array<string>")
    got = {r.grp: r.closure for r in grouped_closure(df).collect()}
    assert got == {1: ["a"], 2: ["d"], 3: [], None: ["e"]}
    assert {r.grp: r.closure for r in grouped_closure(df, max_group=1).collect()}[2] == []
