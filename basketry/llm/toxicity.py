r"""Toxicity by multiple-instance learning: only documents are labelled, and a
document is toxic if any of its sentences is.

A sentence's score is a logistic function of the set of its hashed words and
word stems; a
document's score is the noisy-or of its sentences, 1 - prod(1 - p). The weights
are fitted to document labels through that noisy-or, so the sentence scores come
with it and point at the offending sentences.

The fit uses a bounded sample of labelled documents (``TRAINING_DOCUMENTS``,
whole texts, on the driver: their word buckets only); scoring covers every
document.

Words are lower-cased runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F]; sentences end at
. ! ? and line ends. Defined results: a null or empty text is one sentence without
words; labels that are null are not used, and of several labels of one document
the largest counts; without labels, or with one class alone, every sentence gets
the same score; repeated documents are scored each for themselves; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

#: Bound on the labelled documents that the model is fitted on (expected number).
TRAINING_DOCUMENTS = 4_000
BUCKET_BITS = 21
#: Buckets that fewer training documents hold get no weight.
LEAST_DOCUMENTS = 5
#: Beside a word itself, its first so many bytes count as features.
STEMS = (4, 5, 6)
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, first: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Logits of the sentences whose first bucket has the given index."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
        return sums[np.append(first[1:], len(buckets))] - sums[first] + self.bias


def _sentences(data: np.ndarray, offsets: np.ndarray):
    """For a chunk: bounds of each sentence in bytes, the index of each text's
    first sentence (n + 1), each sentence's first bucket, and the buckets
    (distinct within a sentence). Every text has a sentence."""
    low = C.LOWER[data]
    starts, ends, _ = C.word_bounds(low, offsets, C.ALNUM)
    prefix = C.prefix_hashes(low)
    hashes, at = [C.mix(C.range_hashes(prefix, starts, ends) + np.uint64(1))], [starts]
    for size in STEMS:
        longer = starts[ends - starts > size]
        hashes.append(C.mix(C.range_hashes(prefix, longer, longer + size) + np.uint64(2 * size)))
        at.append(longer)
    bucket = (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    starts = np.concatenate(at)
    stops = np.flatnonzero(_STOPS[data]) + 1
    lengths = np.diff(offsets)
    bounds = np.unique(np.concatenate([offsets, stops]))
    # empty texts have a sentence of no bytes of their own
    empty = offsets[:-1][lengths == 0]
    begin = np.sort(np.concatenate([bounds[:-1], empty]), kind="stable")
    first_of = np.searchsorted(begin, offsets, "left")
    rank = np.concatenate([[0], np.cumsum(lengths == 0)])
    # empty texts at the same place share it: count those before each text
    same = rank - rank[np.searchsorted(offsets, offsets, "left")]
    first_sentence = first_of + same
    first_sentence[-1] = len(begin)
    end = np.append(begin[1:], offsets[-1])
    sentence = np.searchsorted(begin, starts, "right") - 1
    keys = np.unique((sentence << BUCKET_BITS) | bucket)
    of, buckets = keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)
    return begin, end, first_sentence, np.searchsorted(of, np.arange(len(begin))), buckets


def _training_rows(batches):
    for batch in batches:
        out = []
        for row, data, offsets in C.chunks(batch.column(1)):
            _, _, sentences, first, buckets = _sentences(data, offsets)
            edges = np.append(first, len(buckets))
            for i, (a, b) in enumerate(zip(sentences[:-1].tolist(), sentences[1:].tolist())):
                out.append((batch.column(0)[row + i].as_py(), np.diff(edges[a:b + 1]).astype(np.int32).tobytes(),
                            buckets[edges[a]:edges[b]].astype(np.int32).tobytes()))
        yield pa.RecordBatch.from_pydict({"toxic": pa.array([x[0] for x in out], pa.int32()),
                                          "sizes": pa.array([x[1] for x in out], pa.binary()),
                                          "buckets": pa.array([x[2] for x in out], pa.binary())})


def fit(labels: np.ndarray, sentences: np.ndarray, sizes: np.ndarray, buckets: np.ndarray,
        steps: int = 200, rate: float = 0.15, decay: float = 0.5) -> Model:
    """Full-batch Adam on the noisy-or likelihood. ``sentences`` are counts per
    document, ``sizes`` buckets per sentence; ``decay`` pulls weights to zero."""
    width = 1 << BUCKET_BITS
    if not len(labels) or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99))
        return Model(np.zeros(width, np.float32), float(np.log(share / (1 - share))))
    doc_of_sentence = np.repeat(np.arange(len(labels), dtype=np.int32), sentences)
    sentence_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    pairs = np.unique(doc_of_sentence[sentence_of].astype(np.int64) << BUCKET_BITS | buckets)
    keep = np.bincount(pairs & (width - 1), minlength=width) >= LEAST_DOCUMENTS
    del pairs
    used = keep[buckets]
    place = np.cumsum(keep, dtype=np.int32) - 1
    names, column, sentence_of = np.flatnonzero(keep), place[buckets[used]], sentence_of[used]
    w = np.zeros(len(names) + 1)
    w[-1] = np.log(max(labels.mean(), 1e-3) / max(sentences.mean(), 1))
    m, v = np.zeros_like(w), np.zeros_like(w)
    positive = labels == 1
    for step in range(1, steps + 1):
        z = np.bincount(sentence_of, w[column], len(sizes)) + w[-1]
        total = np.bincount(doc_of_sentence, np.logaddexp(0, z), len(labels))
        slope = np.where(positive, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), 1.0)
        each = slope[doc_of_sentence] / (1 + np.exp(-z))
        grad = np.append(np.bincount(column, each[sentence_of], len(names)) + decay * w[:-1], each.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(width, np.float32)
    weights[names] = w[:-1]
    return Model(weights, float(w[-1]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_DOCUMENTS) -> Model:
    """The model of a bounded sample of the labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    C.small_batches(spark)
    known = (labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("training")), F.lit(1 << 20))
    sample = known.where(place < int(min(1.0, bound / max(n, 1)) * (1 << 20)))
    rows = (docs.select("doc_id", "text").join(sample, "doc_id").select("toxic", "text")
            .mapInArrow(_training_rows, "toxic int, sizes binary, buckets binary").toPandas())
    sizes = [np.frombuffer(x, np.int32) for x in rows["sizes"]]
    buckets = [np.frombuffer(x, np.int32) for x in rows["buckets"]]
    none = np.zeros(0, np.int32)
    return fit(rows["toxic"].to_numpy(np.int64), np.array([len(x) for x in sizes], np.int64),
               np.concatenate([none, *sizes]), np.concatenate([none, *buckets]))


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, offending (start, end, score): the sentences of at least
    ``threshold``, in code points."""
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            scores, offending = [], []
            for _, data, offsets in C.chunks(batch.column(1)):
                begin, end, texts, first, buckets = _sentences(data, offsets)
                z = model.sentences(first, buckets)
                total = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, z))])
                scores.append(-np.expm1(-(total[texts[1:]] - total[texts[:-1]])))
                p = 1 / (1 + np.exp(-z))
                bad = np.flatnonzero(p >= threshold)
                found = [[] for _ in range(len(offsets) - 1)]
                if len(bad):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    of = np.searchsorted(texts, bad, "right") - 1
                    zero = points[offsets[of]]
                    for doc, s, e, x in zip(of.tolist(), (points[begin[bad]] - zero).tolist(),
                                            (points[end[bad]] - zero).tolist(), p[bad].tolist()):
                        found[doc].append({"start": s, "end": e, "score": x})
                offending += found
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.clip(np.concatenate([np.zeros(0), *scores]), 0.0, 1.0)),
                 pa.array(offending, pa.list_(kind))], names=["doc_id", "score", "offending"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, score double, offending array<struct<start: bigint, end: bigint, score: double>>")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_texts(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"))
