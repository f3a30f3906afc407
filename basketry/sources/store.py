"""Parquet persistence for lattices (S8) and sweep results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_itemsets(nodes: DataFrame, edges: DataFrame | None, path: str,
                   mode: str = "overwrite") -> None:
    """Nodes (and edges) as Parquet under ``path``."""
    base = path.rstrip("/")
    nodes.write.mode(mode).parquet(f"{base}/nodes")
    if edges is not None:
        edges.write.mode(mode).parquet(f"{base}/edges")


def read_itemsets(spark: SparkSession, path: str, with_edges: bool = True):
    base = path.rstrip("/")
    nodes = spark.read.parquet(f"{base}/nodes")
    if not with_edges:
        return nodes
    return nodes, spark.read.parquet(f"{base}/edges")


def write_sweep(results: DataFrame, path: str) -> None:
    """Append the long sweep table, one folder per sweep."""
    results.write.mode("append").partitionBy("sweep").parquet(path)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
