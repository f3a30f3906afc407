r"""Token counts by dynamic programming over prefixes.

Byte-level BPE splits a text into pieces and encodes each piece on its own.
``PrefixBpe`` encodes every prefix of a piece in one pass: the encoding of a
prefix is that of a shorter prefix and one last token, and exactly one token
that ends there fits the last token of what stands before it. So the exact
count at every prefix is stored once per distinct piece, and counts,
truncations and budgets are answered by sums and look-ups, never by encoding
again.

Each worker keeps the prefix counts of the pieces it has met in a table of
bounded size, which starts anew when it is full.

Defined results: a null or empty text has 0 tokens; special strings inside a
text are the special tokens that the library makes of them; texts are counted
whole, whatever their length; repeated rows give a row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import ctypes
import gc
import json
import unicodedata
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import common as C

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: The code points of \s in the pattern of the vocabulary.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def code_point_classes() -> np.ndarray:
    """Letter, number, space or other, for every code point."""
    global _classes
    if _classes is None:
        kind = defaultdict(lambda: _OTHER, dict.fromkeys(("Lu", "Ll", "Lt", "Lm", "Lo"), _LETTER))
        kind.update(dict.fromkeys(("Nd", "Nl", "No"), _NUMBER))
        _classes = np.fromiter(map(kind.__getitem__, map(unicodedata.category, map(chr, range(0x110000)))),
                               np.uint8, 0x110000)
        _classes[_SPACES] = _SPACE
    return _classes


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    table = code_point_classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int32)
        more = 1 + (b >= 0xE0) + (b >= 0xF0)
        point = b & (0x3F >> more)
        for k in (1, 2, 3):
            at = more >= k
            point[at] = (point[at] << 6) | (data[lead[at] + k] & 0x3F)
        kind = table[point]
        out[lead] = kind
        for k in (1, 2, 3):
            at = more >= k
            out[lead[at] + k] = kind[at]
    return out


def piece_bounds(data: np.ndarray, offsets: np.ndarray):
    r"""Starts and ends of the pieces that the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
    makes of each text, and the index of each text's first piece (n + 1)."""
    n = len(data)
    kind = _byte_classes(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = edge[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    blank = data == 0x20
    # a word takes the one blank before it; other white space before it stands alone
    follows = ~edge[1:n] & ~space[1:] & space[:-1]
    start = change.copy()
    start[1:] &= ~(follows & blank[:-1])
    last = np.flatnonzero(follows)
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last) if len(last) else last
    start[last] = True
    # contractions
    mark = np.flatnonzero((data == 0x27) & start)
    if len(mark):
        end = offsets[np.searchsorted(offsets, mark, "right")]
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a = np.where(mark + 1 < end, padded[mark + 1], 0)
        b = np.where(mark + 2 < end, padded[mark + 2], 0)
        one = np.isin(a, list(b"stmd"))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[mark[one | two] + 1] = False
        stop = np.where(two, mark + 3, mark + 2)[one | two]
        stop = stop[stop < n]
        start[stop] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)[:len(starts)]
    return starts, ends, np.searchsorted(starts, offsets)


class PrefixBpe:
    """Prefix encodings of pieces by the merges of a byte-level BPE vocabulary."""

    _MOST_PAIRS = 1_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
        as_bytes = {t: bytes(byte_of[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {as_bytes[t]: i for t, i in spec["model"]["vocab"].items()}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.tails = {t[k:] for t in self.ids for k in range(len(t))}
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._fit: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """Plain BPE, merge by merge."""
        parts = [self.ids[text[i:i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            best = min((self.merges.get(p, (1 << 30, 0)) for p in zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and self.merges.get((parts[i], parts[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fits(self, before: int, token: int) -> bool:
        known = self._fit.get((before, token))
        if known is None:
            if len(self._fit) >= self._MOST_PAIRS:
                self._fit.clear()
            # -1: the token opens the piece
            pair = [token] if before < 0 else [before, token]
            known = self._fit[before, token] = self.merged(b"".join(self.tokens[t] for t in pair)) == pair
        return known

    def prefixes(self, piece: bytes) -> tuple[list[int], list[int]]:
        """The last token and the number of tokens of each prefix."""
        last, count = [], []
        ids, tails, fits = self.ids, self.tails, self._fits
        for i in range(1, len(piece) + 1):
            j = i - 1
            while True:
                token = ids.get(piece[j:i])
                if token is not None and fits(last[j - 1] if j else -1, token):
                    break
                j -= 1
                if j < 0 or piece[j:i] not in tails:
                    raise ValueError(f"no token ends the prefix {piece[:i]!r}")
            last.append(token)
            count.append(count[j - 1] + 1 if j else 1)
        return last, count

    def encode(self, piece: bytes) -> list[int]:
        last, _ = self.prefixes(piece)
        out, i = [], len(piece)
        while i:
            out.append(last[i - 1])
            i -= len(self.tokens[out[-1]])
        return out[::-1]

    def piece_encoder(self):
        """The same encodings from a compiled library, which takes the ids as
        merge ranks; usable where these follow the order of the merges."""
        ranked = [i for _, i in sorted(self.merges.values())]
        if ranked != sorted(ranked):
            return self.encode
        import tiktoken
        coder = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})
        # a piece needs no splitting: its bytes are merged as they stand
        return coder._core_bpe.encode_single_piece


#: The first 0 to 8 bytes of a little-endian word.
_WORD_PARTS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as far as there are 8."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


class PieceTable:
    """Values of distinct pieces, found by 64-bit hashes for whole arrays of
    pieces at once and confirmed by their bytes, so equal hashes of different pieces
    do no harm. ``solve`` gives a piece's array of values; arrays stand one
    behind the other in ``flat``, the pieces in ``text``. Bounded: it starts anew when it is half full."""

    def __init__(self, solve, dtype, log_slots: int = 20, most_values: int = 1 << 24):
        self.solve, self.dtype, self.slots, self.most_values = solve, dtype, 1 << log_slots, most_values
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int64)
        self.size = np.zeros(self.slots, np.int32)
        self.flat = np.zeros(1 << 16, self.dtype)
        self.text_at = np.zeros(self.slots, np.int64)
        self.text_size = np.zeros(self.slots, np.int32)
        self.text = np.zeros(1 << 16, np.uint8)
        self.used = self.pieces = self.text_used = 0

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """The slot that holds each hash, or else the free slot for it."""
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            held = self.keys[slot[open_]]
            open_ = open_[(held != 0) & (held != h[open_])]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
        return slot

    @staticmethod
    def _appended(store: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
        need = used + len(more)
        # words are read up to 7 bytes beyond the end
        if need + 8 > len(store):
            store = np.concatenate([store, np.zeros(max(need + 8 - len(store), len(store)), store.dtype)])
        store[used:need] = more
        return store, need

    def _put(self, values: list) -> tuple[np.ndarray, np.ndarray]:
        """Place and size of new arrays in ``flat``."""
        sizes = np.array([len(v) for v in values], np.int64)
        at = self.used + np.cumsum(sizes) - sizes
        if values and isinstance(values[0], list):
            more = np.fromiter(chain.from_iterable(values), self.dtype, int(sizes.sum()))
            self.flat, self.used = self._appended(self.flat, self.used, more)
        elif values:
            self.flat, self.used = self._appended(self.flat, self.used, np.concatenate(
                [np.asarray(v, self.dtype) for v in values]))
        return at, sizes

    def _add(self, hashes: np.ndarray, pieces: list[bytes], values: list) -> None:
        at, sizes = self._put(values)
        lengths = np.array([len(p) for p in pieces], np.int64)
        text_at = self.text_used + np.cumsum(lengths) - lengths
        self.text, self.text_used = self._appended(self.text, self.text_used, np.frombuffer(b"".join(pieces), np.uint8))
        self.pieces += len(values)
        todo = np.arange(len(hashes))
        while len(todo):
            slot = self._probe(hashes[todo])
            _, first = np.unique(slot, return_index=True)
            now, where = todo[first], slot[first]
            self.keys[where], self.at[where], self.size[where] = hashes[now], at[now], sizes[now]
            self.text_at[where], self.text_size[where] = text_at[now], lengths[now]
            todo = np.delete(todo, first)

    def _others(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The pieces whose slot holds another piece of the same hash, compared by words of 8
        bytes; the last word of a piece counts as far as the piece goes."""
        length = ends - starts
        other = self.text_size[slot] != length
        given, held = _words(np.frombuffer(raw + bytes(8), np.uint8)), _words(self.text)
        rest = np.flatnonzero(~other)
        a, b, left = starts[rest], self.text_at[slot[rest]], length[rest]
        while len(rest):
            apart = ((given[a] ^ held[b]) & _WORD_PARTS[np.minimum(left, 8)]) != 0
            other[rest[apart]] = True
            more = np.flatnonzero(~apart & (left > 8))
            rest, a, b, left = rest[more], a[more] + 8, b[more] + 8, left[more] - 8
        return np.flatnonzero(other)

    def __call__(self, raw: bytes, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(place in ``flat``, number of values) of each piece."""
        h = C.mix(C.range_hashes(prefix, starts, ends) + (ends - starts).astype(np.uint64)) | np.uint64(1)
        slot = self._probe(h)
        missing = np.flatnonzero(self.keys[slot] == 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            if 2 * (self.pieces + len(new)) > self.slots or max(self.used, self.text_used) > self.most_values:
                while 2 * len(h) > self.slots:
                    self.slots *= 2
                self._empty()
                new, first = np.unique(h, return_index=True)
                missing = np.arange(len(h))
            of = missing[first]
            pieces = [raw[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist())]
            self._add(new, pieces, [self.solve(p) for p in pieces])
            slot = self._probe(h)
        at, size = self.at[slot], self.size[slot]
        others = self._others(raw, starts, ends, slot)
        if len(others):
            at[others], size[others] = self._put([self.solve(raw[a:b]) for a, b in
                                                  zip(starts[others].tolist(), ends[others].tolist())])
        return at, size


_models: dict[str, PrefixBpe] = {}
_tables: dict[tuple[str, str], PieceTable] = {}
_libraries: dict[str, Tokenizer] = {}


def model(path: str) -> PrefixBpe:
    """The worker's copy of a vocabulary."""
    if path not in _models:
        _models[path] = PrefixBpe(path)
    return _models[path]


def library(path: str) -> Tokenizer:
    if path not in _libraries:
        _libraries[path] = Tokenizer.from_file(path)
    return _libraries[path]


def forget() -> None:
    """Free the worker's vocabularies and tables of pieces; they are built again when asked for."""
    if not (_models or _tables or _libraries):
        return
    for kept in (_models, _tables, _libraries):
        kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    # glibc keeps what small objects leave free, over 100 MB here
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def id_type(m: PrefixBpe) -> type:
    """The narrowest numbers that hold all ids of a vocabulary."""
    return np.uint16 if max(m.tokens, default=0) < 1 << 16 else np.uint32


def piece_table(path: str, kind: str) -> PieceTable:
    """Kind "counts": tokens of each prefix; "ids": the tokens."""
    if (path, kind) not in _tables:
        m = model(path)
        solve, dtype = ((lambda p: m.prefixes(p)[1]), np.int32) if kind == "counts" else (m.piece_encoder(), id_type(m))
        _tables[path, kind] = PieceTable(solve, dtype)
    return _tables[path, kind]


def token_counts(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text of a chunk."""
    raw = data.tobytes()
    starts, ends, first = piece_bounds(data, offsets)
    table = piece_table(path, "counts")
    at, size = table(raw, C.prefix_hashes(data), starts, ends)
    total = np.concatenate([[0], np.cumsum(table.flat[at + size - 1] if len(at) else [], dtype=np.int64)])
    out = np.diff(total[first])
    if any(s.encode() in raw for s in model(path).special):
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if any(s.encode() in raw[a:b] for s in model(path).special):
                out[i] = len(library(path).encode(raw[a:b].decode(), add_special_tokens=False).ids)
    return out


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a chunk, and the n + 1 bounds of each text's."""
    raw = data.tobytes()
    starts, ends, first = piece_bounds(data, offsets)
    table = piece_table(path, "ids")
    at, size = table(raw, C.prefix_hashes(data), starts, ends)
    end = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    ids = table.flat[np.arange(end[-1]) + np.repeat(at - end[:-1], size)]
    bounds = end[first]
    if any(s.encode() in raw for s in model(path).special):
        each = np.split(ids, bounds[1:-1])
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if any(s.encode() in raw[a:b] for s in model(path).special):
                each[i] = np.array(library(path).encode(raw[a:b].decode(), add_special_tokens=False).ids, ids.dtype)
        ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
    return ids, bounds


class PrefixCounts:
    """Token counts of every prefix of one text without special strings, and
    the longest prefix within a budget; nothing is encoded again."""

    def __init__(self, text: str, path: str):
        self.raw = text.encode()
        data = np.frombuffer(self.raw, np.uint8)
        self.starts, self.ends, _ = piece_bounds(data, np.array([0, len(data)]))
        self.spaces = _byte_classes(data) == _SPACE
        m = model(path)
        self._prefixes = m.prefixes
        self.within = [m.prefixes(self.raw[a:b])[1] for a, b in zip(self.starts, self.ends)]
        self.before = np.concatenate([[0], np.cumsum([w[-1] for w in self.within])]).astype(np.int64)

    def count(self, end: int) -> int:
        """Tokens of the first ``end`` bytes, a whole number of characters."""
        if end <= 0:
            return 0
        i = int(np.searchsorted(self.starts, end, "left")) - 1
        a = int(self.starts[i])
        if self.spaces[end - 1]:
            # a text that ends in white space: its last run is one piece
            while a and self.spaces[a - 1]:
                i -= 1
                a = int(self.starts[i])
            return int(self.before[i]) + self._prefixes(self.raw[a:end])[1][-1]
        part = self.raw[a:end]
        if len(part) == 2 and end < self.ends[i] and part in (b"'r", b"'v", b"'l"):
            return int(self.before[i]) + 2
        return int(self.before[i]) + self.within[i][end - a - 1]

    def truncate(self, budget: int) -> int:
        """The most bytes of whole characters with at most ``budget`` tokens."""
        i = int(np.searchsorted(self.before, budget, "right"))
        end = int(self.ends[min(i, len(self.ends) - 1)]) if len(self.ends) else 0
        while end and (self.count(end) > budget or end < len(self.raw) and self.raw[end] & 0xC0 == 0x80):
            end -= 1
        return end


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens."""
    C.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, counts = [], []
            for _, data, offsets in C.chunks(batch.column(1)):
                sizes.append(np.diff(offsets))
                counts.append(token_counts(data, offsets, path))
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts))],
                    names=["doc_id", "n_bytes", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")


def truncate_texts(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """``docs`` with each text cut to the longest prefix of at most ``budget``
    tokens (null stays null)."""
    C.small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            cut = [t if t is None else (c := PrefixCounts(t, path)).raw[:c.truncate(budget)].decode() for t in texts]
            yield batch.set_column(place, batch.schema.field(place), pa.array(cut, batch.column(place).type))

    return docs.mapInArrow(run, docs.schema)


def token_report(docs: DataFrame, path: str, limit: int) -> DataFrame:
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
