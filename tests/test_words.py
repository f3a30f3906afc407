"""Queries over the words of the documents hold no table of words in the executors, and MLlib
gets the codes of the frequent ones only."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

import __spark_entry__ as entry
from basket_helpers import as_dict, make_baskets
from basketry import session
from basketry.plans import frequent
from basketry.plans.frequent import frequent_itemsets_fp

DATA = "/root/testdata/sf0.001"


def kept_tables(monkeypatch):
    """The tables that are persisted from now on."""
    kept, persist = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a, **k: kept.append(self) or persist(self, *a, **k))
    return kept


@pytest.mark.parametrize("query", ["f2_min_support_words", "j6_closed_any_words", "j6_closed_only_words", "m10_reachable_words",
                                   "m8_rules_words", "a13_level_union_words"])
def test_words_of_large_scans_are_not_kept(spark, monkeypatch, query):
    small = sorted(map(str, entry.queries()[query](spark, DATA).collect()))
    monkeypatch.setattr(session, "RESCAN_BYTES", 0, raising=False)
    # the scan is dealt out only where it has fewer partitions than tasks run at once
    monkeypatch.setattr(entry.T, "spread", lambda df: df)
    kept = kept_tables(monkeypatch)
    assert sorted(map(str, entry.queries()[query](spark, DATA).collect())) == small and small
    assert all(k.columns == ["codes"] for k in kept)


def test_only_plain_scans_are_read_again(spark, monkeypatch, tmp_out):
    make_baskets(spark, [[1, 2], [2, 3]] * 50).write.parquet(f"{tmp_out}/b")
    df = spark.read.parquet(f"{tmp_out}/b")
    scan = df.where("basket_id > 3").select("basket_id", F.array_distinct("items").alias("items"))
    others = [df.groupBy("items").agg(F.min("basket_id").alias("basket_id")), df.join(df.select("basket_id"), "basket_id")]
    assert session.plain_scan(scan) and not any(session.plain_scan(x) for x in others)
    with session.persisted(scan) as b:
        assert b.storageLevel.useMemory
    monkeypatch.setattr(session, "RESCAN_BYTES", 10)
    with session.persisted(scan) as b:
        assert not b.storageLevel.useMemory and not b.storageLevel.useDisk
    with session.persisted(others[1]) as b:
        assert b.storageLevel.useMemory


@pytest.mark.parametrize("rare", [3, 300])
@pytest.mark.parametrize("least", [2, 5])
def test_the_miner_gets_frequent_codes_only(spark, monkeypatch, rare, least):
    """Rare items, baskets without a frequent one, repeats and nulls stay away from MLlib. With ``least`` 2 and
    300 items in pairs of baskets, the codes are beyond those looked up in a literal map."""
    got, miner = [], frequent.FPGrowth

    class Watched(miner):
        def fit(self, dataset, params=None):
            got.append((dataset.storageLevel.useMemory, [r[0] for r in dataset.collect()]))
            return super().fit(dataset, params)

    monkeypatch.setattr(frequent, "FPGrowth", Watched)
    rows = [["a", "b"]] * 5 + [["a", "b", "b", None]] * 3 + [["c"], [], None] + [[f"r{k}"] for k in range(rare)] * 2
    df = spark.createDataFrame([(1, x) for x in rows], "basket_id long, items array<string>")
    want = {("a",): 8, ("b",): 8, ("a", "b"): 8} | ({(f"r{k}",): 2 for k in range(rare)} if least == 2 else {})
    for ratio in (None, (least - 0.5) / len(rows)):
        found = frequent_itemsets_fp(df, min_count=None if ratio else least, min_ratio=ratio)
        assert as_dict(found) == want and all(r["size"] == len(r["items"]) for r in found.collect())
    codes = len([i for i in want if len(i) == 1])
    for kept, baskets in got:
        assert kept and len(baskets) == 8 + (2 * rare if least == 2 else 0)
        assert {c for b in baskets for c in b} == set(range(codes))
