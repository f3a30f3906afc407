r"""Suffix-array deduplication: every byte that a string of ``length`` bytes
covers is removed if that string also starts earlier (in an earlier document, or
earlier in the same one).

Only suffixes at anchors are sorted. An anchor is the place of the smallest hash
of 32 bytes within a string of 100; equal strings have the same anchor, so all
their copies meet under the anchor's hash, and a place that shares its hash with
no other is dropped at once. Under one hash, equal surroundings (as far as a
string through the anchor can reach) are folded first: all but the earliest are
covered. Where different surroundings remain, the suffixes from the anchor on,
and the reversed prefixes before it, are put in order by a merge sort whose
comparisons find the common extension by binary search over prefix polynomial
hashes; neighbours' common extensions are verified byte by byte. For each place
of the string around the anchor, runs of both orders then name the equal
strings, and all but the earliest of them are covered.

No hash gathers an unbounded group. Anchors are counted in 2^HOT_BITS buckets of their
hashes first; those of a full bucket are dealt out by their surroundings too, which
fold just the same. A hash that still has more than ``WIDE`` surroundings is not sorted:
each string of 100 bytes around its anchors goes by its own 128-bit hash, of which a
task sends on the earliest only.

Texts are UTF-8 bytes; matches never cross documents. Documents come in the
order of their ids. Defined results: a null or empty text has no bytes and keeps
none; rows with one id and different texts are ordered by the texts' CRC-32, and
rows equal in both count as one document and get the same result; a null id
comes before all others; an empty table gives no rows; other columns are not
read. Surroundings are folded by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

LENGTH = 100
GRAM = 32
#: How far left of an anchor a string through it can start.
REACH = LENGTH - GRAM
#: Anchors per group of the index, and anchors folded at a time in a scan.
ENTRIES, FOLDED = 300_000, 400_000
#: Records whose suffixes are sorted at a time (a gram's are never parted), and the
#: most surroundings of a gram that is sorted.
SORTED = WIDE = 16_000
#: Anchors are counted in 2^HOT_BITS buckets; one with so many more than others is full.
HOT_BITS, HOT = 20, 32_000
_FIRST_ID = -(1 << 63)
_PLACE = [("id", "<i8"), ("tie", "<u4"), ("at", "<i4")]
_ANCHOR = np.dtype([("gram", "<u8"), ("around", "<u8"), *_PLACE, ("left", "u1"), ("right", "u1")])
_SPAN = np.dtype([("id", "<i8"), ("tie", "<u4"), ("start", "<i4"), ("end", "<i4")])


def _slide(x: np.ndarray, width: int, best, backward: bool = False) -> np.ndarray:
    """best of x[i:i + width] (or x[i - width + 1:i + 1]), short at the end."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        if backward:
            out[step:] = best(out[step:], out[:-step])
        else:
            out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray):
    """For a chunk: places of anchors, their hashes, the bytes that strings
    through them reach to the left and right, and the prefix hashes."""
    prefix = C.prefix_hashes(data)
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, prefix
    start = np.arange(n - GRAM + 1)
    gram = C.mix(C.range_hashes(prefix, start, start + GRAM))
    least = _slide(gram, REACH + 1, np.minimum)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        least[max(a, b - LENGTH + 1):b] = 0
    place = np.flatnonzero((_slide(least, REACH + 1, np.maximum, backward=True) == gram) & (gram != 0))
    doc = np.searchsorted(offsets, place, "right") - 1
    # the strings of a short text hold no grams of the text before it
    left = np.minimum(place - offsets[doc], REACH)
    right = np.minimum(offsets[doc + 1] - place, LENGTH)
    whole = left + right >= LENGTH
    return place[whole], gram[place[whole]], left[whole], right[whole], prefix


def _records(batch: pa.RecordBatch):
    """For each chunk of (id, tie, text): its bytes, anchor places and records."""
    ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for row, data, offsets in C.chunks(batch.column(2)):
        place, gram, left, right, prefix = anchors(data, offsets)
        doc = np.searchsorted(offsets, place, "right") - 1
        x = np.zeros(len(place), _ANCHOR)
        x["gram"], x["left"], x["right"] = gram, left, right
        x["id"], x["tie"], x["at"] = ids[row + doc], ties[row + doc], place - offsets[doc]
        x["around"] = C.mix(C.range_hashes(prefix, place - left, place + right)
                            + (left * 128 + right).astype(np.uint64))
        yield data, place, x


def _in_order(x: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Order by the given keys (the last first), then by document and place."""
    return np.lexsort((x["at"], x["tie"], x["id"], *keys))


def _fold(x: np.ndarray):
    """The earliest record of each surrounding of each gram, ordered by gram,
    and the spans that all others cover. A record that comes again at the same
    place is of a repeated row, which is the same document: it covers nothing."""
    order = _in_order(x, x["around"], x["gram"])
    x = x[order]
    again = np.zeros(len(x), bool)
    again[1:] = (x["gram"][1:] == x["gram"][:-1]) & (x["around"][1:] == x["around"][:-1])
    later = again.copy()
    later[1:] &= (x["id"][1:] != x["id"][:-1]) | (x["tie"][1:] != x["tie"][:-1]) | (x["at"][1:] != x["at"][:-1])
    return x[~again], _spans(x[later], x["left"][later], x["right"][later].astype(np.int32)), order[~again]


def _spans(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Spans from ``left`` bytes before to ``right`` bytes behind the places,
    joined within each document."""
    s = np.zeros(len(x), _SPAN)
    s["id"], s["tie"], s["start"], s["end"] = x["id"], x["tie"], x["at"] - left.astype(np.int32), x["at"] + right
    s = s[np.lexsort((s["start"], s["tie"], s["id"]))]
    if not len(s):
        return s
    doc = np.cumsum(np.append(False, (s["id"][1:] != s["id"][:-1]) | (s["tie"][1:] != s["tie"][:-1])))
    # ends so far within the document: documents are lifted above each other
    lift = doc.astype(np.int64) << 32
    reach = np.maximum.accumulate(lift + s["end"])
    new = np.append(True, lift[1:] + s["start"][1:] > reach[:-1])
    out = s[new]
    out["end"] = (reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)] & 0xFFFFFFFF).astype(np.int32)
    return out


_PACKED = "part int, entries binary, spans binary"


def _buckets(gram: np.ndarray) -> np.ndarray:
    return (C.mix(gram) >> np.uint64(64 - HOT_BITS)).astype(np.int64)


def _count_anchors(batches):
    """At the end of a partition: the counts of its anchors in 64 parts."""
    counts = np.zeros(1 << HOT_BITS, np.int64)
    for batch in batches:
        for _, data, offsets in C.chunks(batch.column(0)):
            counts += np.bincount(_buckets(anchors(data, offsets)[1]), minlength=1 << HOT_BITS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(64, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(counts.astype(np.int32), 64)], pa.binary())],
        names=["part", "counts"])


def _add_counts(key, table):
    total = np.zeros((1 << HOT_BITS) // 64, np.int64)
    for x in table["counts"]:
        total += np.frombuffer(x.as_buffer(), np.int32)
    return pa.Table.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()),
                                 "counts": pa.array([total.tobytes()], pa.binary())})


def full_buckets(texts: DataFrame) -> np.ndarray:
    """Which buckets of grams hold far more anchors than others (2^HOT_BITS flags)."""
    counts = np.zeros(1 << HOT_BITS, np.int64)
    for row in (texts.select("text").mapInArrow(_count_anchors, "part int, counts binary")
                .groupBy("part").applyInArrow(_add_counts, "part int, counts binary").collect()):
        counts.reshape(64, -1)[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return counts > counts.mean() + 8 * np.sqrt(counts.mean()) + HOT


def _pack(x: np.ndarray, spans: np.ndarray, parts: int, texts=None, full=None) -> pa.RecordBatch:
    """Records by the part that their gram, and in a full bucket their surroundings too, go
    to; the spans go with any part."""
    key = C.mix(x["gram"])
    if full is not None:
        key = np.where(full[_buckets(x["gram"])], C.mix(key ^ x["around"]), key)
    part = (key % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(x)]])
    rows = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            own = x[order[a:b]]
            data = b"".join(np.ascontiguousarray(own[f]).tobytes() for f in own.dtype.names)
            if texts is not None:
                data += b"".join(texts[i] for i in order[a:b])
            rows.append((int(part[order[a]]), len(own), data, b""))
    if len(spans):
        rows.append((int(C.mix(spans["id"][:1].view(np.uint64))[0] % np.uint64(parts)), 0, b"", spans.tobytes()))
    return pa.RecordBatch.from_pydict({
        "part": pa.array([r[0] for r in rows], pa.int32()),
        "entries": pa.array([np.int64(r[1]).tobytes() + r[2] for r in rows], pa.binary()),
        "spans": pa.array([r[3] for r in rows], pa.binary())})


def _unpack(table: pa.Table):
    """All records of a group, the rest of each row's bytes, and the spans."""
    records, rest = [np.zeros(0, _ANCHOR)], []
    for value in table["entries"]:
        raw = value.as_buffer()
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        x, at = np.zeros(n, _ANCHOR), 8
        for f in _ANCHOR.names:
            x[f] = np.frombuffer(raw, _ANCHOR[f], n, at)
            at += n * _ANCHOR[f].itemsize
        records.append(x)
        rest.append(np.frombuffer(raw, np.uint8, len(raw) - at, at) if len(raw) > at else np.zeros(0, np.uint8))
    spans = [np.zeros(0, _SPAN)] + [np.frombuffer(s.as_buffer(), _SPAN) for s in table["spans"]]
    return np.concatenate(records), np.concatenate([np.zeros(0, np.uint8), *rest]), np.concatenate(spans)


def _index(shared, parts: int):
    def run(batches):
        held, size, full = [], 0, shared.value
        for batch in batches:
            for _, _, x in _records(batch):
                held.append(x)
                size += len(x)
                if size >= FOLDED:
                    yield _pack(*_fold(np.concatenate(held))[:2], parts, full=full)
                    held, size = [], 0
        if held:
            yield _pack(*_fold(np.concatenate(held))[:2], parts, full=full)
    return run


def _found(spans: np.ndarray, grams: np.ndarray, around: np.ndarray) -> pa.Table:
    """Rows of spans, and rows of grams with their number of surroundings."""
    n, m = len(spans), len(grams)
    def column(name, kind):
        return pa.concat_arrays([pa.array(spans[name].astype(kind)), pa.nulls(m, pa.from_numpy_dtype(kind))])
    return pa.Table.from_pydict({
        "id": column("id", np.int64), "tie": column("tie", np.int64), "start": column("start", np.int32),
        "end": column("end", np.int32),
        "gram": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(grams.view(np.int64))]),
        "around": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(around.astype(np.int64))])})


_FOUND = "id long, tie long, start int, end int, gram long, around long"
_NO_GRAMS = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _shared_grams(shared):
    """Folds the records of a part; grams with several surroundings are named, and those
    of full buckets always, as they may have more in other parts."""
    def run(key, table):
        x, _, spans = _unpack(table)
        x, covered, _ = _fold(x)
        grams, around = np.unique(x["gram"], return_counts=True)
        named = (around > 1) | shared.value[_buckets(grams)]
        return _found(np.concatenate([spans, covered]), grams[named], around[named])
    return run


def _strings(x: np.ndarray, place: np.ndarray, raw: bytes) -> np.ndarray:
    """Each string of LENGTH bytes around the anchors of ``x`` as a record of its own: its
    hash for gram and surroundings, its start for place."""
    first = np.maximum(LENGTH - x["right"].astype(np.int64), 0)
    each = x["left"].astype(np.int64) - first + 1
    before = np.arange(each.sum()) + np.repeat(first - (np.cumsum(each) - each), each)
    start = np.repeat(place, each) - before
    names = b"".join(hashlib.blake2b(raw[s:s + LENGTH], digest_size=16).digest() for s in start.tolist())
    out = np.repeat(x, each)
    out["gram"], out["around"] = np.frombuffer(names, np.uint64).reshape(-1, 2).T
    out["at"] -= before.astype(np.int32)
    out["left"], out["right"] = 0, LENGTH
    return out


def _surroundings(shared, wide, parts: int, string_parts: int):
    """Records, with their surroundings, of the grams that a bit table lets through; of
    the wide ones the strings, in parts of their own behind the others."""
    def run(batches):
        let_through, is_wide = shared.value, wide.value

        def flush(held):
            x, spans, kept = _fold(np.concatenate([h[0] for h in held]))
            texts = [t for h in held for t in h[1]]
            return _pack(x, spans, parts, [texts[i] for i in kept])

        def flush_strings(strings):
            out = _pack(*_fold(np.concatenate(strings))[:2], string_parts)
            return out.set_column(0, "part", pa.array(out.column(0).to_numpy() + np.int32(parts)))

        held, size, strings, n_strings = [], 0, [], 0
        for batch in batches:
            for data, place, x in _records(batch):
                hit = let_through(x["gram"])
                if not hit.any():
                    continue
                raw, apart = data.tobytes(), is_wide(x["gram"])
                own = np.flatnonzero(hit & ~apart)
                if len(own):
                    low, high = place[own] - x["left"][own], place[own] + x["right"][own]
                    held.append((x[own], [raw[a:b] for a, b in zip(low.tolist(), high.tolist())]))
                    size += len(own)
                    if size >= FOLDED // 4:
                        yield flush(held)
                        held, size = [], 0
                own = np.flatnonzero(hit & apart)
                for at in range(0, len(own), 1 + FOLDED // 16):
                    some = own[at:at + 1 + FOLDED // 16]
                    strings.append(_strings(x[some], place[some], raw))
                    n_strings += len(strings[-1])
                    if n_strings >= FOLDED:
                        yield flush_strings(strings)
                        strings, n_strings = [], 0
        if held:
            yield flush(held)
        if strings:
            yield flush_strings(strings)
    return run


def _common(prefix, a, b, limit):
    """Bytes that the texts at a and b have in common, at most ``limit``: binary
    search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), limit.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) // 2
        same = C.range_hashes(prefix, a, a + middle) == C.range_hashes(prefix, b, b + middle)
        low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)


def suffix_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray):
    """Merge sort of the strings ``data[start:start + size]`` within runs of
    equal ``group``: the order, and each string's common extension with the one
    before it (-1 for the first of a group)."""
    n = len(start)
    prefix, padded = C.prefix_hashes(data), np.append(data, np.uint8(0))
    order = np.arange(n)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    base = np.repeat(first, np.diff(np.append(first, n)))
    most = int(np.diff(np.append(first, n)).max()) if n else 0

    def before(i, j, equal):
        """Whether string i comes before string j; ``equal`` if they are equal."""
        shared = _common(prefix, start[i], start[j], np.minimum(size[i], size[j]))
        ends_i, ends_j = shared == size[i], shared == size[j]
        less = padded[np.where(ends_i, len(data), start[i] + shared)] < padded[
            np.where(ends_j, len(data), start[j] + shared)]
        return np.where(ends_i & ends_j, equal, np.where(ends_i, True, np.where(ends_j, False, less)))

    place, end = np.arange(n) - base, base + np.repeat(np.diff(np.append(first, n)), np.diff(np.append(first, n)))
    width = 1
    while width < most:
        # each string's rank among the strings of the neighbouring sorted run
        run = place // width
        is_left = run % 2 == 0
        other = base + np.where(is_left, run + 1, run - 1) * width
        low, high = np.minimum(other, end), np.minimum(other + width, end)
        other = low.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            # equal strings keep the order of the runs
            ahead = before(order[middle], order[open_], ~is_left[open_])
            low[open_] = np.where(ahead, middle + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], middle)
        merged = np.where(is_left, np.arange(n), np.arange(n) - width) + (low - other)
        out = np.empty(n, np.int64)
        out[merged] = order
        order, width = out, 2 * width
    shared = np.full(n, -1, np.int64)
    inner = np.flatnonzero(np.arange(n) != base)
    a, b = order[inner - 1], order[inner]
    shared[inner] = _common(prefix, start[a], start[b], np.minimum(size[a], size[b]))
    return order, shared


def _verified_order(data, start, size, group, longest: int):
    """``suffix_order`` with its common extensions checked byte by byte; if a
    hash misled it, the strings are sorted by their bytes."""
    order, shared = suffix_order(data, start, size, group)
    padded = np.append(data, np.zeros(longest, np.uint8))

    def exact(order):
        out = np.full(len(order), -1, np.int64)
        inner = np.flatnonzero(np.append(False, group[1:] == group[:-1]))
        for at in range(0, len(inner), 20_000):
            i = inner[at:at + 20_000]
            a, b = order[i - 1], order[i]
            step = np.arange(longest)
            differ = (padded[start[a][:, None] + step] != padded[start[b][:, None] + step])
            differ |= step >= np.minimum(size[a], size[b])[:, None]
            out[i] = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
        return out

    true = exact(order)
    if (true != shared).any():
        raw = data.tobytes()
        order = np.array(sorted(range(len(start)), key=lambda i: (
            group[i], raw[start[i]:start[i] + size[i]])), np.int64)
        true = exact(order)
    return order, true


def covered_by_earlier(x: np.ndarray, around: list[np.ndarray]) -> np.ndarray:
    """Spans that earlier strings cover; ``x`` is ordered by gram, then document
    and place, and ``around`` are the surroundings."""
    n = len(x)
    left, right = x["left"].astype(np.int64), x["right"].astype(np.int64)
    size = left + right
    data = np.concatenate(around)
    at = np.cumsum(size) - size
    back = np.concatenate([a[:k][::-1] for a, k in zip(around, left.tolist())])
    group = np.cumsum(np.append(False, x["gram"][1:] != x["gram"][:-1]))
    by_suffix, suffix_shared = _verified_order(data, at + left, right, group, LENGTH)
    by_prefix, prefix_shared = _verified_order(back, np.cumsum(left) - left, left, group, REACH)
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    suffix, before = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(REACH + 1):
        # runs of equal strings of `a` bytes before, and of the rest from, the anchor
        suffix[by_suffix] = np.cumsum(suffix_shared < LENGTH - a)
        before[by_prefix] = np.cumsum(prefix_shared < a)
        reach = np.flatnonzero((left >= a) & (right >= LENGTH - a))
        key = suffix[reach] * (n + 1) + before[reach]
        order = np.argsort(key, kind="stable")
        again = reach[order[1:][key[order[1:]] == key[order[:-1]]]]
        low[again] = np.where(low[again] < 0, a, low[again])
        high[again] = a
    hit = np.flatnonzero(high >= 0)
    return _spans(x[hit], high[hit], (LENGTH - low[hit]).astype(np.int32))


def _covered(parts: int):
    """Spans that a part's records cover: strings are folded, surroundings sorted."""
    def run(key, table):
        if key[0].as_py() < parts:
            return _sorted_suffixes(table)
        x, _, spans = _unpack(table)
        return _found(np.concatenate([spans, _fold(x)[1]]), *_NO_GRAMS)
    return run


def _sorted_suffixes(table):
    x, data, spans = _unpack(table)
    size = x["left"].astype(np.int64) + x["right"]
    begin = np.cumsum(size) - size
    kept, covered, rows = _fold(x)
    order = _in_order(kept, kept["gram"])
    kept, rows = kept[order], rows[order]
    shared = np.append(False, kept["gram"][1:] == kept["gram"][:-1])
    several = shared | np.append(shared[1:], False)
    found = [spans, covered]
    kept, rows = kept[several], rows[several]
    # whole grams, about SORTED records at a time
    gram = np.flatnonzero(np.append(True, kept["gram"][1:] != kept["gram"][:-1]))[:len(kept)]
    at = 0
    while at < len(kept):
        later = gram[gram >= min(at + SORTED, len(kept))]
        end = int(later[0]) if len(later) else len(kept)
        found.append(covered_by_earlier(kept[at:end], [data[begin[i]:begin[i] + size[i]] for i in rows[at:end]]))
        at = end
    return _found(np.concatenate(found), *_NO_GRAMS)


def _removed(batches):
    """Counts and digest of each text without its spans."""
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2)
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for i in range(batch.num_rows):
            raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
            kept, at, runs = [], 0, 0
            cuts = spans[i].as_py() or []
            for cut in sorted((c["start"], c["end"]) for c in cuts):
                if cut[0] > at or not runs:
                    kept.append(raw[at:cut[0]])
                    runs += 1
                at = max(at, cut[1])
            kept.append(raw[at:])
            rest = b"".join(kept)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(rest))
            out["n_spans"].append(runs)
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v) for v in out.values()]],
                                         names=["doc_id", *out])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """id, tie, spans (start, end) in bytes, for texts with a byte to remove;
    id and tie as ``with_keys`` names them."""
    spark = docs.sparkSession
    C.small_batches(spark)
    scan = with_keys(docs).select("id", "tie", "text").where(F.octet_length("text") >= LENGTH)
    total = scan.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0
    parts = max(1, int(total * 2 // (REACH + 2) // ENTRIES))
    full = spark.sparkContext.broadcast(full_buckets(scan))
    found = C.stored(scan.mapInArrow(_index(full, parts), _PACKED).groupBy("part").applyInArrow(_shared_grams(full), _FOUND),
                     "repeat_spans")
    grams = C.stored(found.where(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("around").alias("around"))
                     .where("around > 1"), "repeat_grams")
    bits = spark.sparkContext.broadcast(C.BitTable(grams.select("gram")))
    many = grams.where(F.col("around") > WIDE)
    wide = spark.sparkContext.broadcast(C.BitTable(many.select("gram")))
    strings = (many.agg(F.sum("around")).collect()[0][0] or 0) * (REACH + 1)
    string_parts = max(1, int(strings) // ENTRIES)
    spans = found.where(F.col("gram").isNull()).union(
        scan.mapInArrow(_surroundings(bits, wide, parts, string_parts), _PACKED)
        .groupBy("part").applyInArrow(_covered(parts), _FOUND))
    return spans.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def with_keys(docs: DataFrame) -> DataFrame:
    """The keys of a document's place in the order: its id, then its CRC-32."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("id"),
                       F.crc32(F.coalesce("text", F.lit(""))).alias("tie"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (with_keys(docs).join(repeated_spans(docs), ["id", "tie"], "left").select("doc_id", "text", "spans")
            .mapInArrow(_removed, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
