r"""BPE encoding and decoding by a contiguous rank array.

A text is cut into the pieces of the vocabulary's pattern and each piece is
encoded on its own. A short piece keeps its parts in one array of boundaries and,
beside it, one array with the merge rank of every two adjacent parts: the least
rank is looked for again and again (the leftmost of equal ones), the boundary it
stands for is deleted, and the ranks on both sides are refreshed. Scanning costs
the square of the length, so a piece of more than ``SHORT`` bytes keeps the same
boundaries as a linked list and its ranks in a heap; both give the same tokens.
Decoding joins the bytes of the tokens and reads them as UTF-8.

Each worker keeps the encodings of pieces it has met, found by their bytes, in
two tables of bounded size: when the newer is full it becomes the older one.

Defined results: a null or empty text has no ids, and no ids decode to an empty
text; a special string inside a text is its special token, as the library
makes it; ids that the vocabulary lacks decode to nothing, bytes that are not
UTF-8 to U+FFFD; texts are encoded whole, whatever their length; repeated rows
give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C
from basketry.llm.tokens import piece_bounds

#: Longest piece, in bytes, whose ranks are scanned.
SHORT = 128
#: Pieces and bytes of pieces in each of the two tables that a worker keeps.
MOST_PIECES, MOST_BYTES = 1 << 18, 1 << 24
_NONE = 1 << 62


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: a
    printable byte is itself, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary: ids of pieces and texts, and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of, vocabulary = _byte_characters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocabulary.items()}
        self.single = [vocabulary[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        self.size = 1 + max([*tokens, *self.special.values()])
        #: left id * size + right id -> rank * size + id of both, so that ranks compare first
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[a] * self.size + vocabulary[b]] = rank * self.size + vocabulary[a + b]
        tokens |= {i: t.encode() for t, i in self.special.items()}
        self.token_bytes = [tokens.get(i, b"") for i in range(self.size)]
        # the bytes of all tokens one behind the other; the last entry stands for unknown ids
        self._length = np.array([len(t) for t in self.token_bytes] + [0])
        self._at = np.cumsum(self._length) - self._length
        self._blob = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self._cut = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.special, key=len, reverse=True))
                               if self.special else rb"(?!)")
        self._known, self._older, self._held = {}, {}, 0

    def scanned(self, piece: bytes) -> tuple[list[int], list[int]]:
        """(ids, boundaries) of a short piece by scanning its rank array."""
        size, ranks = self.size, self.ranks
        ids = [self.single[b] for b in piece]
        bounds = list(range(len(ids) + 1))
        rank = [ranks.get(a * size + b, _NONE) for a, b in zip(ids, ids[1:])]
        while rank:
            least = min(rank)
            if least == _NONE:
                break
            i = rank.index(least)
            ids[i] = least % size
            del ids[i + 1], bounds[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get(ids[i] * size + ids[i + 1], _NONE)
            if i:
                rank[i - 1] = ranks.get(ids[i - 1] * size + ids[i], _NONE)
        return ids, bounds

    def queued(self, piece: bytes) -> tuple[list[int], list[int]]:
        """The same for a long piece, its ranks in a heap."""
        size, ranks, n = self.size, self.ranks, len(piece)
        ids = [self.single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(a * size + b for a, b in zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] * size + ids[j] != pair:
                continue
            ids[i], ids[j] = rank % size, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                pair = ids[left] * size + ids[right] if left >= 0 and right < n else -1
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], left, pair))
        starts = [i for i in range(n) if ids[i] >= 0]
        return [ids[i] for i in starts], [*starts, n]

    def solved(self, piece: bytes) -> bytes:
        """The ids of a piece that the newer table lacks, as 32-bit numbers; now it holds it."""
        ids = self._older.get(piece)
        if ids is None:
            ids = np.array((self.scanned(piece) if len(piece) <= SHORT else self.queued(piece))[0], np.int32).tobytes()
        if len(self._known) >= MOST_PIECES or self._held + len(piece) > MOST_BYTES:
            # emptied in place, as a loop over pieces may hold it
            self._older = dict(self._known)
            self._known.clear()
            self._held = 0
        if len(piece) <= MOST_BYTES:
            self._known[piece] = ids
            self._held += len(piece)
        return ids

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk, and the n + 1 bounds of each text's."""
        raw, edges, special = data.tobytes(), offsets, {}
        for m in self._cut.finditer(raw):
            row = int(np.searchsorted(offsets, m.start(), "right"))
            if m.end() <= offsets[row]:
                special[m.start()] = self.special[m[0].decode()]
                edges = np.append(edges, m.span())
        # each special string is a text of its own to the pattern; equal edges are empty texts
        starts, ends, _ = piece_bounds(data, np.unique(edges) if special else edges)
        if special:
            at = np.array(sorted(special))
            length = np.array([len(self.token_bytes[special[a]]) for a in at.tolist()])
            inside = np.searchsorted(at, starts, "right") - 1
            outside = (inside < 0) | (starts >= at[inside] + length[inside])
            starts, ends = starts[outside], ends[outside]
            starts, ends = np.concatenate([starts, at]), np.concatenate([ends, at + length])
            order = np.argsort(starts)
            starts, ends = starts[order], ends[order]
        known, solved = self._known.get, self.solved
        own = {s: np.int32(i).tobytes() for s, i in special.items()}
        if own:
            parts = [own.get(a) or known(raw[a:b]) or solved(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        else:
            parts = [known(raw[a:b]) or solved(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        first = np.searchsorted(starts, offsets)
        end = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)])
        return np.frombuffer(b"".join(parts), np.int32), end[first]

    def text(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.chunk(raw, np.array([0, len(raw)]))[0].tolist()

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        known = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        length = self._length[known]
        end = np.concatenate([[0], np.cumsum(length)])
        raw = self._blob[np.arange(end[-1]) + np.repeat(self._at[known] - end[:-1], length)].tobytes()
        edges = end[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(edges, edges[1:])]

    def decode(self, ids) -> str:
        return self.decoded(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


_coders: dict[str, Bpe] = {}


def coder(path: str) -> Bpe:
    """The worker's copy of a vocabulary."""
    if path not in _coders:
        _coders[path] = Bpe(path)
    return _coders[path]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids, the tokens of ``text``."""
    C.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for row, data, offsets in C.chunks(batch.column(1)):
                ids, bounds = coder(path).chunk(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(bounds) - 1),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids`` (null ids: null)."""
    C.small_batches(encoded.sparkSession)
    place = encoded.columns.index("ids")

    def run(batches):
        for batch in batches:
            given = batch.column(place)
            bounds = np.concatenate([[0], np.cumsum(given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            texts = coder(path).decoded(given.flatten().to_numpy(zero_copy_only=False), bounds)
            texts = pa.array(texts, pa.string(), mask=given.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kept}, decoded string")


def bpe_report(docs: DataFrame, path: str) -> DataFrame:
    coded = decode_texts(encode_texts(docs, path), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
