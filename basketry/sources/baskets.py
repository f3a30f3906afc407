"""Basket sources and sinks.

A basket table is ``DataFrame<basket_id, items: array<T>>`` with ``items``
distinct and sorted. Every row is a basket, whatever its id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.itemsets import canonical
from basketry.operators.encoding import BROADCAST_ROWS
from basketry.session import scanned_bytes

# Fixed value of the reference's document text format: the record delimiter.
DOCUMENT_DELIMITER = "---END.OF.DOCUMENT---"

# White space as Java's ``\s`` defines it, spelled out so RE2 (DuckDB) agrees.
WHITESPACE = r"[ \t\n\x0B\f\r]+"


def _tokens(text_col, sep_regex: str, keep_empty: bool):
    toks = F.split(text_col, sep_regex)
    if not keep_empty:
        toks = F.array_remove(toks, "")
    return toks


def _typed(tokens, item_type: str, hashed: bool):
    if hashed:
        # xxhash64 per token (the reference hashes words the same way);
        # distinct words may collide, as in the reference.
        return F.transform(tokens, lambda t: F.xxhash64(t))
    if item_type in ("bigint", "long"):
        return F.transform(tokens, lambda t: t.cast("long"))
    return tokens


# No scan cuts a file into pieces smaller than this (Spark's cost of opening one).
LEAST_SPLIT_BYTES = 4 << 20


def numbered_records(records: DataFrame) -> DataFrame:
    """``(basket_id, value)`` of a text scan: the records of all files numbered from 0,
    files in the order of their paths.

    The number of a record does not depend on how the files are cut into splits and
    dealt to tasks, so samples by id (P1) stay the same under any cluster or setting.
    One scan counts the records of each split; the splits before a record and its
    place in its own split give its number. The table of splits has a row for each
    split that the driver plans; it is broadcast while the files' size bounds it, and the
    two scans share one plan, so both see the same splits.
    """
    spark = records.sparkSession
    placed = records.select("value", F.col("_metadata.file_path").alias("path"),
                            F.col("_metadata.file_block_start").alias("block"),
                            F.monotonically_increasing_id().alias("place"))
    before = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (placed.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
                    .select("path", "block",
                            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")))
    least = min(LEAST_SPLIT_BYTES, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    if len(records.inputFiles()) + scanned_bytes(records) // max(least, 1) <= BROADCAST_ROWS:
        splits = F.broadcast(splits)
    return placed.join(splits, ["path", "block"]).select((F.col("place") + F.col("shift")).alias("basket_id"), "value")


def _records(records: DataFrame, stable_ids: bool) -> DataFrame:
    if stable_ids:
        return numbered_records(records)
    return records.select(F.monotonically_increasing_id().alias("basket_id"), "value")


def read_baskets(spark: SparkSession, path: str, sep: str = " ", item_type: str = "string",
                 keep_empty: bool = False, hashed: bool = False,
                 num_partitions: int | None = None, escaped: bool = False,
                 stable_ids: bool = True) -> DataFrame:
    """One basket per text line, items separated by ``sep``.

    ``basket_id`` is the number of the line (see ``numbered_records``).
    ``stable_ids=False`` saves the scan that counts the lines: the ids then follow the
    file split, and id-based samples (P1) change with it. ``escaped`` undoes the
    escapes of ``write_baskets``.
    """
    import re
    df = _records(spark.read.text(path), stable_ids)
    toks = _tokens(F.col("value"), re.escape(sep), keep_empty)
    if escaped:
        toks = F.transform(toks, lambda t: _unescaped(t, sep))
    out = df.select("basket_id",
                    canonical(_typed(toks, item_type, hashed)).alias("items"))
    if num_partitions:
        out = out.repartition(num_partitions, "basket_id")
    return out


def text_to_baskets(df: DataFrame, id_col: str, text_col: str, hashed: bool = False,
                    sep_regex: str = WHITESPACE, lower: bool = True) -> DataFrame:
    """S3: lower-case, split on white space, distinct words (or their hashes)."""
    t = F.col(text_col)
    if lower:
        t = F.lower(t)
    toks = _tokens(t, sep_regex, keep_empty=False)
    return df.select(F.col(id_col).alias("basket_id"),
                     canonical(_typed(toks, "string", hashed)).alias("items"))


def read_delimited_documents(spark: SparkSession, path: str,
                             delimiter: str = DOCUMENT_DELIMITER, hashed: bool = False,
                             lower: bool = False, stable_ids: bool = True) -> DataFrame:
    """Multi-line records cut at ``delimiter``, split on white space
    (which also strips them); records without a word are dropped. Ids as in S1."""
    df = _records(spark.read.option("lineSep", delimiter).text(path), stable_ids)
    b = text_to_baskets(df, "basket_id", "value", hashed=hashed, lower=lower)
    return b.where(F.size("items") > 0)


def baskets_from_rows(df: DataFrame, key_cols: str | Sequence[str], item_col: str) -> DataFrame:
    """S4, transaction form: one row per (transaction, item) -> one basket.

    ``collect_set`` is partially aggregated on the map side, so a hot
    transaction reaches the final aggregation as at most one set per task.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    key = F.col(keys[0]) if len(keys) == 1 else F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return (df.where(F.col(item_col).isNotNull())
              .groupBy(key.alias("basket_id"))
              .agg(F.sort_array(F.collect_set(item_col)).alias("items")))


def attribute_baskets(df: DataFrame, id_col, attrs: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """S4, attribute form: one basket per row with items ``name=value``.

    ``attrs`` maps the item prefix to the column. Nulls are left out; the
    columns of ``keep`` stay beside the basket.
    """
    items = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{p}="), F.col(c).cast("string")))
                      for p, c in attrs.items()])
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    return df.select(idc.alias("basket_id"),
                     F.sort_array(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("items"), *keep)


def _escapes(sep: str) -> list[tuple[str, str]]:
    """What stands for characters that would part an item or a line: % first."""
    return [(c, "".join(f"%{b:02X}" for b in c.encode())) for c in dict.fromkeys(["%", sep, "\n", "\r"])]


def _escaped(item, sep: str):
    for char, code in _escapes(sep):
        item = F.replace(item, F.lit(char), F.lit(code))
    return item


def _unescaped(token, sep: str):
    for char, code in reversed(_escapes(sep)):
        token = F.replace(token, F.lit(code), F.lit(char))
    return token


def write_baskets(baskets: DataFrame, path: str, sep: str = " ", mode: str = "overwrite") -> None:
    """One line per basket, items separated by ``sep``. Separators, line ends
    and % inside an item are written as %XX; ``read_baskets(escaped=True)`` gives
    the items back."""
    (baskets.select(F.array_join(F.transform("items", lambda x: _escaped(x.cast("string"), sep)), sep).alias("value"))
            .write.mode(mode).text(path))


def write_documents(df: DataFrame, text_col: str, path: str,
                    delimiter: str = DOCUMENT_DELIMITER, mode: str = "overwrite") -> None:
    """Writer counterpart of S2: records separated by ``delimiter``."""
    df.select(F.col(text_col).alias("value")).write.mode(mode).option("lineSep", delimiter).text(path)


def generate_zipf_baskets(spark: SparkSession, n: int, draws: int = 50, a: float = 1.1,
                          seed: int = 0, block: int = 4096,
                          num_partitions: int | None = None) -> DataFrame:
    """``n`` baskets, each the set of ``draws`` Zipf(``a``) draws.

    Ids come from ``spark.range``; each fixed block of ``block`` ids has its own
    generator seeded by (seed, block), so the data does not depend on how Spark
    splits the range.
    """
    ids = spark.range(0, n, numPartitions=num_partitions) if num_partitions else spark.range(0, n)

    def gen(batches):
        for pdf in batches:
            idv = pdf["id"].to_numpy()
            out = []
            for b in np.unique(idv // block):
                rng = np.random.default_rng([seed, int(b)])
                z = rng.zipf(a, size=(block, draws))
                sel = idv[(idv // block) == b] - b * block
                out.extend(np.unique(z[i]).astype(np.int64).tolist() for i in sel)
            yield pd.DataFrame({"basket_id": idv, "items": out})

    return ids.mapInPandas(gen, "basket_id long, items array<long>")
