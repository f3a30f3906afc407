"""Packing by lexical retrieval: documents fill sequences of a fixed number of
tokens together with the documents most like them.

Texts are encoded once into a stored table. From it each document gets its *route*: its
``ROUTE_TERMS`` heaviest terms by BM25, the heaviest first. The documents are range-partitioned
by route and row into shards of about ``SHARD_TOKENS`` tokens, so that documents that agree
in their heaviest terms, copies above all, meet in one shard or in neighbouring ones however large
the corpus is, while the row parts a route that very many documents share. A partition is read
in that order and closed as a shard at ``MOST_TOKENS``, so a shard's memory has a bound whatever the ranges
hold. Routes and index weigh terms alike, by document frequencies over all documents, which the
encoding counts; routes are taken from the stored ids, so no text is encoded twice.

Each shard has an inverted index of BM25 weights. A sequence starts with a seed; the
seed's terms (without the end id) query the index, and the neighbours that are not
used yet fill the window from the best on, as long as one shares a term; only then
comes the next document by route. The document that does not fit any more is
cut, and its rest seeds the next sequence, so only a shard's last sequence is
padded.

Defined results: a null or empty text is the end id alone; special strings
inside a text are the special tokens that the library makes of them; texts are
packed whole, whatever their length; repeated rows are packed each for
themselves; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C
from basketry.llm.tokens import forget, model, token_ids

SEQUENCE = 2048
END_ID = 1
SHARD_TOKENS = 2_000_000
MOST_TOKENS = 2 * SHARD_TOKENS
#: Terms of a route.
ROUTE_TERMS = 3
#: Neighbours ranked at first; each further ranking of a window takes twice as many.
NEIGHBOURS = 16
#: An index drops its used documents once so small a share of it is free.
NARROW = 0.75
K1, B = 1.2, 0.75
_IDS = np.dtype("<u2")
MOST_IDS = 1 << 16


def term_counts(ids: np.ndarray, bounds: np.ndarray):
    """(document, term, count) of all documents' terms, by document and term."""
    # 32 bits hold a document and a term in all but shards of very short texts
    wide = np.uint32 if len(bounds) <= 1 << 16 else np.int64
    keys = np.repeat(np.arange(len(bounds) - 1, dtype=wide) << 16, np.diff(bounds)) | ids.astype(wide)
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    count = np.diff(first, append=len(keys))
    keys = keys[first].astype(np.int64)
    # the end id, which every document has, relates none
    shared = (keys & 0xFFFF) != END_ID
    keys, count = keys[shared], count[shared]
    return keys >> 16, keys & 0xFFFF, count


def rarity(holding: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - holding + 0.5) / (holding + 0.5))


def term_weights(idf, doc, term, count, bounds, mean: float) -> np.ndarray:
    """BM25 weights of the terms of ``term_counts``."""
    size = np.diff(bounds)[doc]
    return idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size / mean))


def routes(doc, term, weight, n: int) -> np.ndarray:
    """Each document's heaviest terms, 16 bits each, the heaviest first (of equal ones
    the smaller id; 0xFFFF where it has fewer)."""
    out, weight = np.zeros(n, np.int64), weight.copy()
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    for _ in range(ROUTE_TERMS):
        best = np.full(n, 0xFFFF, np.int64)
        if len(first):
            most = np.maximum.reduceat(weight, first)
            at = np.flatnonzero((weight == np.repeat(most, np.diff(first, append=len(doc)))) & (weight > 0))
            at = at[np.flatnonzero(np.diff(doc[at], prepend=-1))]
            best[doc[at]] = term[at]
            weight[at] = -1
        out = (out << 16) | best
    return out


def _encode(path: str):
    """A row (doc_id, ids, n_tokens) per text and, at the end of a partition, the
    number of its texts that hold each id. Only tasks load the vocabulary."""
    def run(batches):
        vocabulary = max(model(path).tokens) + 1 + len(model(path).special)
        if vocabulary > MOST_IDS:
            raise ValueError("packing keeps ids in 16 bits: the vocabulary may have 65,536 ids at most")
        holding, id_type = np.zeros(vocabulary, np.int64), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            out = []
            for _, data, offsets in C.chunks(batch.column(1)):
                ids, bounds = token_ids(data, offsets, path)
                _, term, _ = term_counts(ids, bounds)
                holding += np.bincount(term, minlength=vocabulary)
                holding[END_ID] += len(bounds) - 1
                ids = np.insert(ids.astype(_IDS), bounds[1:], END_ID)
                bounds = bounds + np.arange(len(bounds))
                raw = ids.tobytes()
                out += [raw[2 * a:2 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(out, pa.binary()),
                     pa.array([len(x) // 2 for x in out], pa.int64()), pa.nulls(len(out), pa.list_(pa.int64()))],
                    names=["doc_id", "ids", "n_tokens", "holding"])
        if id_type is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()),
                 pa.array([holding], pa.list_(pa.int64()))], names=["doc_id", "ids", "n_tokens", "holding"])
    return run


def _route(shared, documents: int, mean: float):
    """The rows of a batch (``ids`` third) with their route."""
    def run(batches):
        idf = rarity(shared.value, documents)
        for batch in batches:
            route = [np.zeros(0, np.int64)]
            for _, data, offsets in C.chunks(batch.column(2)):
                bounds = offsets // 2
                doc, term, count = term_counts(data.view(_IDS), bounds)
                route.append(routes(doc, term, term_weights(idf, doc, term, count, bounds, mean), len(bounds) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(route))],
                                             names=[*batch.schema.names, "route"])
    return run


class Index:
    """BM25 weights of the documents of a shard by term."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, holding: np.ndarray, documents: int, mean: float):
        n = len(bounds) - 1
        doc, term, count = term_counts(ids, bounds)
        idf = rarity(holding, documents)
        weight = term_weights(idf, doc, term, count, bounds, mean)
        # a document's terms, for queries
        self.of_doc = np.searchsorted(doc, np.arange(n + 1))
        self.terms = term
        self.idf = idf
        # postings
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.names, self.first = np.unique(term[order], return_index=True)
        self.first = np.append(self.first, len(term))
        self.n = n
        # terms of an eighth of the documents and more have a whole row of weights each
        held = np.diff(self.first)
        common = 8 * held >= n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((np.count_nonzero(common), n))
        dense = np.repeat(common, held)
        self.rows[np.repeat(self.row, held)[dense], self.docs[dense]] = self.weights[dense]
        # the documents that are scored
        self.left = np.arange(n)

    def narrow(self, free: np.ndarray) -> None:
        """Score only those of the documents that are free; theirs stay what they were."""
        keep = free[self.left]
        kept = keep[self.docs]
        self.first = np.concatenate([[0], np.cumsum(kept)])[self.first]
        self.docs, self.weights = (np.cumsum(keep) - 1)[self.docs[kept]], self.weights[kept]
        self.rows, self.left = np.compress(keep, self.rows, axis=1), self.left[keep]
        self.n = len(self.left)

    def neighbours(self, doc: int) -> np.ndarray:
        """Scores of the documents that are left for all terms of the seed."""
        at = np.searchsorted(self.names, self.terms[self.of_doc[doc]:self.of_doc[doc + 1]])
        row = self.row[at]
        rare = [slice(a, b) for a, b in zip(self.first[at[row < 0]].tolist(), self.first[at[row < 0] + 1].tolist())]
        scores = np.zeros(self.n)
        if rare:
            scores += np.bincount(np.concatenate([self.docs[x] for x in rare]),
                                  np.concatenate([self.weights[x] for x in rare]), self.n)
        for r in row[row >= 0].tolist():
            scores += self.rows[r]
        return scores


def best_first(scores: np.ndarray):
    """Documents with a positive score, the best first, ranked as they are asked for."""
    rest, take = np.flatnonzero(scores > 0), NEIGHBOURS
    while len(rest):
        if take < len(rest):
            most = np.argpartition(-scores[rest], take)[:take]
        else:
            most = np.arange(len(rest))
        ranked = rest[most]
        yield from ranked[np.lexsort((ranked, -scores[ranked]))].tolist()
        rest, take = np.delete(rest, most), 2 * take


def pack(ids: np.ndarray, bounds: np.ndarray, index: Index):
    """(document, start, length, sequence, offset) of all pieces of a shard. ``index`` is
    narrowed to the documents that are not used yet as they get fewer."""
    n = len(bounds) - 1
    size = np.diff(bounds).tolist()
    free = np.ones(n, bool)
    out, unseen, sequence = [], 0, 0
    doc, start = -1, 0
    while True:
        if doc < 0:
            while unseen < n and not free[unseen]:
                unseen += 1
            if unseen == n:
                return out
            doc, start = unseen, 0
            free[doc] = False
        # one window: the seed first, then its neighbours
        seed, ranked, offset = doc, None, 0
        while offset < SEQUENCE:
            take = min(SEQUENCE - offset, size[doc] - start)
            out.append((doc, start, take, sequence, offset))
            offset, start = offset + take, start + take
            if start < size[doc]:
                break
            doc = -1
            if ranked is None:
                if np.count_nonzero(free) < NARROW * index.n:
                    index.narrow(free)
                ranked = map(index.left.__getitem__, best_first(index.neighbours(seed) * free[index.left]))
            doc = int(next((d for d in ranked if free[d]), -1))
            if doc < 0:
                while unseen < n and not free[unseen]:
                    unseen += 1
                if unseen == n:
                    return out
                doc = unseen
            free[doc], start = False, 0
        else:
            doc = -1 if start >= (size[doc] if doc >= 0 else 0) else doc
        sequence += 1


def _pack_partition(shared, documents: int, mean: float):
    """Packs the rows of a partition, which come by route, in shards of ``MOST_TOKENS``
    at most (or one document)."""
    def packed(tables, base: int):
        table = pa.Table.from_batches(tables)
        ids = [np.frombuffer(x.as_buffer(), _IDS) for x in table["ids"]]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        flat = np.concatenate(ids).astype(np.int64)
        pieces = pack(flat, bounds, Index(flat, bounds, shared.value, documents, mean))
        docs, starts, lengths, sequences, offsets = (np.array(x, np.int64) for x in zip(*pieces))
        own = [ids[d][s:s + n] for d, s, n in zip(docs.tolist(), starts.tolist(), lengths.tolist())]
        return pa.Table.from_pydict({
            "doc_id": table["doc_id"].take(pa.array(docs)), "start": starts, "length": lengths,
            "doc_tokens": np.diff(bounds)[docs], "sequence_id": sequences + base, "offset": offsets,
            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
            "ids": pa.array([x.tobytes() for x in own], pa.binary())}), base + int(sequences[-1]) + 1

    def run(batches):
        # ids are read, not made, from here on: a worker that encoded gives the vocabulary's memory back
        forget()
        base, held, tokens = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            size, first, at = batch.column(batch.schema.get_field_index("n_tokens")).to_pylist(), 0, 0
            for at, n in enumerate(size):
                if tokens and tokens + n > MOST_TOKENS:
                    out, base = packed([*held, batch.slice(first, at - first)], base)
                    yield from out.to_batches()
                    held, first, tokens = [], at, 0
                tokens += n
            held.append(batch.slice(first))
        if tokens:
            yield from packed(held, base)[0].to_batches()
    return run


def encoded_documents(docs: DataFrame, path: str) -> tuple[DataFrame, np.ndarray]:
    """(row, doc_id, ids, n_tokens) of all documents from a stored table, and
    how many documents hold each id."""
    C.small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    encoded = C.stored(docs.select("doc_id", "text").mapInArrow(
        _encode(path), f"doc_id {id_type}, ids binary, n_tokens long, holding array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "token_ids")
    counts = (encoded.where(F.col("holding").isNotNull()).select(F.posexplode("holding").alias("id", "n"))
              .where("n > 0").groupBy("id").agg(F.sum("n").alias("n")).toPandas())
    holding = np.zeros(MOST_IDS)
    holding[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float64)
    return encoded.where(F.col("holding").isNull()).select("row", "doc_id", "ids", "n_tokens"), holding


def routed(texts: DataFrame, shared, documents: int, mean: float) -> DataFrame:
    """``texts`` of ``encoded_documents`` with each document's ``route``; ``shared`` is the
    broadcast number of documents that hold each id."""
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_route(shared, documents, mean),
                            f"row long, doc_id {id_type}, ids binary, n_tokens long, route long")


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset,
    ids_crc32 (of unsigned little-endian 32-bit ids) and ids (16-bit)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts, holding = encoded_documents(docs, path)
    documents, total = texts.agg(F.count("*"), F.sum("n_tokens")).collect()[0]
    shards, mean = max(1, -(-int(total or 0) // SHARD_TOKENS)), (total or 0) / max(documents, 1)
    shared = docs.sparkSession.sparkContext.broadcast(holding)
    return (routed(texts, shared, documents, mean)
            .repartitionByRange(shards, "route", "row").sortWithinPartitions("route", "row")
            .select("doc_id", "ids", "n_tokens").mapInArrow(
                _pack_partition(shared, documents, mean),
                f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, "
                "ids_crc32 long, ids binary"))


def packing_report(docs: DataFrame, path: str) -> DataFrame:
    return pack_documents(docs, path).drop("ids")
