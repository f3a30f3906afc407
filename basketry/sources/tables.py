"""Basket tables built from the driver's parquet tables (FIXTURES.md section 4).

Only the needed columns are selected, so the parquet scans read just them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.baskets import attribute_baskets, baskets_from_rows, text_to_baskets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than task slots (a
    single large row group cannot be split). Large inputs already have many
    partitions and pass through untouched, so no shuffle is added at scale."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def _lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part and supplier-nation attributes. The row key
    is taken at the scan (the (order, line) pair is not unique in the data),
    before any repartitioning, so it is reproduced on a task retry."""
    li = (table(spark, sf_dir, "lineitem")
          .select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
          .withColumn("row_key", F.monotonically_increasing_id()))
    li = spread(li)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (li.join(p, li.l_partkey == p.p_partkey)
              .join(s, li.l_suppkey == s.s_suppkey)
              .join(n, F.col("s_nationkey") == n.n_nationkey)
              .join(r, n.n_regionkey == r.r_regionkey))


_LINEITEM_ATTRS = {"flag": "l_returnflag", "status": "l_linestatus", "brand": "p_brand",
                   "type": "p_type", "nat": "n_name", "reg": "r_name"}


def customer_attribute_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One basket per customer: segment, nation, region."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    rows = (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey))
    return attribute_baskets(rows, "c_custkey",
                             {"seg": "c_mktsegment", "nat": "n_name", "reg": "r_name"})


def lineitem_attribute_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One basket per line item: flag, status, part brand and type, supplier
    nation and region."""
    return attribute_baskets(_lineitem_rows(spark, sf_dir), "row_key", _LINEITEM_ATTRS)


def lineitem_grouped_attribute_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item attribute baskets plus the supplier nation key as ``grp``."""
    rows = _lineitem_rows(spark, sf_dir).withColumn("grp", F.col("s_nationkey"))
    return attribute_baskets(rows, "row_key", _LINEITEM_ATTRS, keep=("grp",))


def brand_baskets_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands bought per customer (lineitem x part x orders)."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    return baskets_from_rows(rows, "o_custkey", "p_brand")


def brand_baskets_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands per order (lineitem x part)."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = li.join(p, li.l_partkey == p.p_partkey)
    return baskets_from_rows(rows, "l_orderkey", "p_brand")


def part_baskets_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys per order (bigint items)."""
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))
    return baskets_from_rows(li, "l_orderkey", "l_partkey")


def word_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-cased words per document."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return text_to_baskets(d, "doc_id", "text")


def event_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types per (user, day); basket id ``user_id:yyyy-MM-dd``."""
    e = spread(table(spark, sf_dir, "events").select("user_id", "ts", "event_type"))
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return baskets_from_rows(e.withColumn("ukey", key), "ukey", "event_type")
