r"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item becomes windows of ``size`` consecutive words (an item of
fewer words is one window). A window is a set of shingles (runs of up to three
words). The shingles of a window are ordered by rarity, their document
frequency over all documents, and only the rarest one is the window's prefix:
a text that contains the window contains that shingle. Documents send the
places of shingles that a fixed-size bit table of the prefixes lets through, the
join on the shingle is cut down by the window's length and the shingle's
position, and the words are compared exactly.

Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
Defined results: a null or empty text has no words, no hits and no windows; an
item without an id still marks words but is listed nowhere; repeated items
count once, repeated documents give a row each; an empty benchmark marks
nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 3
#: Documents a part of a prefix shingle holds: one that more documents hold is joined in
#: several parts, each with a copy of its windows.
SALT_ROWS = 512
#: Prefix shingles held by more documents than that which may be broadcast.
HOT_SHINGLES = 100_000


def _words(data, offsets):
    data = C.LOWER[data]
    starts, ends, first = C.word_bounds(data, offsets, C.ALNUM)
    return data.tobytes(), starts, ends, first, C.word_hashes(data, starts, ends)


def _text_words(raw: bytes, starts, ends, a: int, b: int) -> list[str]:
    return [raw[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]


def _windows(size: int):
    """Rows (item_id, words, kind, shingles): the windows of the items."""
    def run(batches):
        for batch in batches:
            out = []
            for row, data, offsets in C.chunks(batch.column(1)):
                raw, starts, ends, first, _ = _words(data, offsets)
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    item = batch.column(0)[row + i].as_py()
                    for s in range(a, max(a, b - size) + 1 if b > a else a):
                        out.append((item, _text_words(raw, starts, ends, s, min(s + size, b))))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([x[0] for x in out], pa.string()),
                                              "words": pa.array([x[1] for x in out], pa.list_(pa.string()))})
    return run


def _window_shingles(batches):
    """Adds to each window the hashes of its shingles, in their order."""
    for batch in batches:
        words = batch.column(batch.schema.get_field_index("words")).to_pylist()
        data, offsets = C.text_bytes(pa.array([" ".join(w) for w in words], pa.large_string()))
        _, starts, ends, first, h = _words(data, offsets)
        by_kind = {k: C.shingle_hashes(h, first, k)[:2] for k in range(1, SHINGLE + 1)}
        kinds = np.clip(np.diff(first), 1, SHINGLE)
        found = [by_kind[k][0][by_kind[k][1][i]:by_kind[k][1][i + 1]].view(np.int64) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(kinds.astype(np.int32)), pa.array(found, pa.list_(pa.int64()))],
            names=[*batch.schema.names, "kind", "shingles"])


def _document_shingles(kinds: list[int], shared):
    """(kind, shingle, n): how many documents of a batch hold each shingle that
    the bit table lets through."""
    def run(batches):
        let_through = shared.value
        for batch in batches:
            found = []
            for _, data, offsets in C.chunks(batch.column(0)):
                _, _, _, first, words = _words(data, offsets)
                for kind in kinds:
                    h, at, _ = C.shingle_hashes(words, first, kind)
                    hit = np.flatnonzero(let_through(h))
                    doc = np.searchsorted(at, hit, "right")
                    pairs = np.unique(np.stack([h[hit], doc.astype(np.uint64)]), axis=1)[0]
                    keys, n = np.unique(pairs, return_counts=True)
                    found.append((np.full(len(keys), kind, np.int32), keys.view(np.int64), n))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*found)], names=["kind", "shingle", "n"])
    return run


def _candidates(size: int, kinds: list[int], shared):
    """One row of kind 0 for each document with its number of words, and a row
    for each place of a shingle that the bit table lets through, with the words
    around it."""
    def run(batches):
        let_through = shared.value
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1)
            take, cols = [], {k: [] for k in ("kind", "shingle", "place", "at", "n_words", "around")}
            for row, data, offsets in C.chunks(batch.column(2)):
                raw, starts, ends, first, words = _words(data, offsets)
                counts = np.diff(first)
                docs = np.arange(row, row + len(counts))
                take.append(docs)
                n = len(docs)
                cols["kind"].append(np.zeros(n, np.int32))
                cols["shingle"].append(rows[docs])
                cols["place"].append(np.zeros(n, np.int64))
                cols["at"].append(np.zeros(n, np.int64))
                cols["n_words"].append(counts)
                cols["around"] += [None] * n
                for kind in kinds:
                    h, at, index = C.shingle_hashes(words, first, kind)
                    hit = np.flatnonzero(let_through(h))
                    doc = np.searchsorted(at, hit, "right") - 1
                    word = index[hit]
                    low = np.maximum(first[doc], word - size + 1)
                    high = np.minimum(first[doc + 1], word + size)
                    take.append(row + doc)
                    cols["kind"].append(np.full(len(hit), kind, np.int32))
                    cols["shingle"].append(h[hit].view(np.int64))
                    cols["place"].append(word - first[doc])
                    cols["at"].append(word - low)
                    cols["n_words"].append(counts[doc])
                    cols["around"] += [_text_words(raw, starts, ends, a, b) for a, b in zip(low, high)]
            if not take:
                continue
            index = np.concatenate(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[index]), ids.take(pa.array(index))]
                + [pa.array(np.concatenate(v)) for k, v in cols.items() if k != "around"]
                + [pa.array(cols["around"], pa.list_(pa.string()))], names=["row", "doc_id", *cols])
    return run


def prefix_index(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """(kind, shingle, j, words, items, salts): each distinct window under its
    rarest shingle, where in the window that shingle stands, and into how many parts
    the documents that hold the shingle are dealt."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), "text")
    windows = (items.mapInArrow(_windows(size), "item_id string, words array<string>")
               .groupBy("words").agg(F.collect_set("item_id").alias("items")))
    windows = C.stored(windows.mapInArrow(
        _window_shingles, "words array<string>, items array<string>, kind int, shingles array<long>"), "windows")
    each = windows.select("kind", F.posexplode("shingles").alias("place", "shingle"), "words", "items")
    kinds = [r[0] for r in windows.select("kind").distinct().collect()]
    bits = spark.sparkContext.broadcast(C.BitTable(each.select("shingle").distinct()))
    frequency = (docs.select("text")
                 .mapInArrow(_document_shingles(kinds, bits), "kind int, shingle long, n long")
                 .groupBy("kind", "shingle").agg(F.sum("n").alias("df")))
    rare = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "place", "items")).alias("p")
    return C.stored(each.join(frequency, ["kind", "shingle"], "left").groupBy("kind", "words").agg(rare)
                    .select("kind", "p.shingle", F.col("p.place").alias("j"), "words", "p.items",
                            (1 + F.floor(F.col("p.df") / SALT_ROWS)).cast("long").alias("salts")), "prefixes")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, spans (start, end in words, of every window found),
    items (ids as strings, sorted): one row per row of ``docs``. ``row``
    numbers the rows."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.select("doc_id", "text")
    index = prefix_index(docs, benchmark, size)
    kinds = [r[0] for r in index.select("kind").distinct().collect()]
    bits = spark.sparkContext.broadcast(C.BitTable(index.select("shingle").distinct()))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = (docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
             .mapInArrow(_candidates(size, kinds, bits),
                         f"row long, doc_id {id_type}, kind int, shingle long, place long, at long, n_words long, "
                         "around array<string>"))
    # at most one row per prefix shingle of the benchmark
    hot = index.where("salts > 1").select("kind", "shingle", "salts").distinct()
    if hot.count() <= HOT_SHINGLES:
        hot = F.broadcast(hot)
    found = (found.join(hot, ["kind", "shingle"], "left")
             .withColumn("salt", F.pmod("row", F.coalesce("salts", F.lit(1)))).drop("salts"))
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    length, start = F.size("words"), F.col("place") - F.col("j")
    inside = (F.col("at") >= F.col("j")) & (start >= 0) & (start + length <= F.col("n_words"))
    same = F.expr("slice(around, cast(at - j + 1 as int), size(words)) = words")
    joined = found.join(salted.select("kind", "shingle", "salt", "j", "words", "items"),
                        (found["kind"] == salted["kind"]) & (found["shingle"] == salted["shingle"])
                        & (found["salt"] == salted["salt"]) & inside & same, "left")
    span = F.when(F.col("j").isNotNull(), F.struct(start.alias("start"), (start + length).alias("end")))
    return (joined.groupBy("row", "doc_id")
            .agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(span)).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    def add(done, span):
        return F.struct((done["n"] + F.greatest(span["end"] - F.greatest(span["start"], done["end"]), F.lit(0)))
                        .alias("n"), F.greatest(done["end"], span["end"]).alias("end"))
    zero = F.lit(0).cast("long")
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("end")), add)["n"]


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    hits = contaminated_words(docs, benchmark).withColumn("n_hit", covered(F.col("spans")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       C.hex_digest_of_list(F.col("items")).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))
