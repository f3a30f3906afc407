"""Text, document and Parquet sources / sinks, and the Zipf generator."""

import os

from pyspark.sql import functions as F

from basketry.operators.sampling import sample_baskets
from basketry.sources import baskets
from basketry.sources.baskets import (attribute_baskets, baskets_from_rows, generate_zipf_baskets,
                                      read_baskets, read_delimited_documents, text_to_baskets,
                                      write_baskets, write_documents)
from basketry.sources.store import read_itemsets, read_sweep, write_itemsets, write_sweep
from basketry.plans.closed import closed_itemsets
from basketry.plans.lattice import itemset_lattice
from basket_helpers import make_baskets


def test_read_baskets_drops_empty_tokens(spark, tmp_out):
    p = os.path.join(tmp_out, "b.txt")
    with open(p, "w") as f:
        f.write("1 2 3 \n3 4\n2 2 1\n")
    b = read_baskets(spark, p, item_type="bigint")
    assert sorted(list(r["items"]) for r in b.collect()) == [[1, 2], [1, 2, 3], [3, 4]]
    assert b.select("basket_id").distinct().count() == 3
    k = read_baskets(spark, p, keep_empty=True)
    assert any("" in r["items"] for r in k.collect())
    h = read_baskets(spark, p, hashed=True)
    assert h.schema["items"].dataType.elementType.simpleString() == "bigint"


def test_write_read_roundtrip(spark, tmp_out):
    b = make_baskets(spark, [[1, 2], [3], [1, 2]])
    path = os.path.join(tmp_out, "out")
    write_baskets(b, path)
    back = read_baskets(spark, path, item_type="bigint")
    assert sorted(list(r["items"]) for r in back.collect()) == [[1, 2], [1, 2], [3]]


def test_delimited_documents(spark, tmp_out):
    docs = spark.createDataFrame([("a b\nc",), ("  b  a ",), ("",)], "text string")
    path = os.path.join(tmp_out, "docs")
    write_documents(docs, "text", path)
    back = read_delimited_documents(spark, path)
    assert sorted(list(r["items"]) for r in back.collect()) == [["a", "b"], ["a", "b", "c"]]


def split_finely(spark, size):
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, size)


def test_ids_do_not_follow_the_file_split(spark, tmp_out):
    os.mkdir(f"{tmp_out}/in")
    lines, n = {}, 0
    for name, count in (("b", 0), ("a", 700), ("d", 1), ("c", 1300)):
        with open(f"{tmp_out}/in/{name}.txt", "w") as f:
            f.writelines(f"{name}{i} x\n" if i % 7 else "\n" for i in range(count))
    for name, count in (("a", 700), ("c", 1300), ("d", 1)):
        for i in range(count):
            lines[n] = sorted([f"{name}{i}", "x"]) if i % 7 else []
            n += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("64", "1000", "128m"):
            split_finely(spark, size)
            b = read_baskets(spark, f"{tmp_out}/in")
            assert {r.basket_id: list(r["items"]) for r in b.collect()} == lines, size
            picked = sample_baskets(b, 0.2, seed=3).select("basket_id").toPandas()["basket_id"]
            assert sorted(picked) == sorted(sample_baskets(spark.range(n).select(F.col("id").alias("basket_id")), 0.2, seed=3)
                                            .toPandas()["basket_id"]), size
            assert read_baskets(spark, f"{tmp_out}/in", stable_ids=False).select("basket_id").distinct().count() == n
        # the join without a broadcast gives the same ids
        baskets.BROADCAST_ROWS, kept = 0, baskets.BROADCAST_ROWS
        try:
            split_finely(spark, "1000")
            assert {r.basket_id: list(r["items"]) for r in read_baskets(spark, f"{tmp_out}/in").collect()} == lines
        finally:
            baskets.BROADCAST_ROWS = kept
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_ids_of_delimited_documents(spark, tmp_out):
    with open(f"{tmp_out}/d.txt", "w") as f:
        f.write("---END.OF.DOCUMENT---".join(f"w{i}\nx" if i % 3 else " \n" for i in range(300)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("100", "128m"):
            split_finely(spark, size)
            got = {r.basket_id: list(r["items"]) for r in read_delimited_documents(spark, f"{tmp_out}/d.txt").collect()}
            assert got == {i: [f"w{i}", "x"] for i in range(300) if i % 3}, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_text_and_row_forms(spark):
    d = spark.createDataFrame([(1, "The cat THE\tdog"), (2, None)], "doc_id long, text string")
    b = {r.basket_id: r["items"] for r in text_to_baskets(d, "doc_id", "text").collect()}
    assert list(b[1]) == ["cat", "dog", "the"]
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, None)], "k long, it string")
    got = {r.basket_id: list(r["items"]) for r in baskets_from_rows(rows, "k", "it").collect()}
    assert got == {1: ["x", "y"]}
    a = spark.createDataFrame([(7, "A", None)], "id long, s string, t string")
    assert list(attribute_baskets(a, "id", {"s": "s", "t": "t"}).first()["items"]) == ["s=A"]


def test_zipf_independent_of_partitioning(spark):
    a = generate_zipf_baskets(spark, 3000, seed=5, num_partitions=2)
    b = generate_zipf_baskets(spark, 3000, seed=5, num_partitions=7)
    da = {r.basket_id: list(r["items"]) for r in a.collect()}
    db = {r.basket_id: list(r["items"]) for r in b.collect()}
    assert da == db and len(da) == 3000
    assert all(1 <= len(v) <= 50 and v == sorted(set(v)) for v in da.values())


def test_lattice_and_sweep_store(spark, tmp_out):
    b = make_baskets(spark, [[1, 2], [1, 2, 3], [2, 3]])
    nodes, edges = itemset_lattice(closed_itemsets(b, min_count=1), relation="cover")
    write_itemsets(nodes, edges, os.path.join(tmp_out, "lat"))
    n2, e2 = read_itemsets(spark, os.path.join(tmp_out, "lat"))
    assert n2.count() == nodes.count() and e2.count() == edges.count()
    res = spark.createDataFrame([("alpha", "alpha", 0.1, "exact", 0, "time", 1.0)],
                                "sweep string, param_label string, param_value double, algorithm string, "
                                "run int, measure string, value double")
    write_sweep(res, os.path.join(tmp_out, "sw"))
    write_sweep(res, os.path.join(tmp_out, "sw"))
    assert read_sweep(spark, os.path.join(tmp_out, "sw")).count() == 2
