r"""N-gram Jaccard join with prefix trees.

A text's set holds its distinct shingles of five words (a shorter text: all its
words as one). All sets are put in one global order, rarest shingles first, by
document counts over all documents in a table of 2^20 buckets. Two sets with a
Jaccard similarity of at least t share a shingle within the first
n - ceil(t n) + 1 of each, so the sets that share such a prefix shingle form a
list, and only sets of one list are compared. In a list, the ordered sets are
stored in a trie; a probing set walks it, shares the overlap of common paths,
and leaves a subtree when the overlap so far and the lengths left on both sides
cannot reach the threshold. Links between sets that are connected already are
not looked for.

Before any sets are moved, lists are cut down losslessly: a pair is left out
where the place of its first common shingle, or the sum over 128 classes of the
smaller of both counts of shingles, shows that its overlap cannot be enough.

Equal sets are one set from the start: prefixes are reduced to one per set before
they are counted and indexed, so copies add nothing to a list. A shingle that very
many distinct sets have in their prefix is dealt out to cells of two parts each, so
that every pair still meets and no list grows without bound. Each set is first tried with the smallest
sets of some of its lists, and those of a pivot that very many sets have are dealt out to
several lists; lists whose sets are all connected by then need no further work.

Words are lower-cased (A-Z) runs of [^\x20\x09-\x0D]. Sets and shingles are
known by 64-bit hashes. Defined results: a null or empty text, or one without
words, has an empty set and links with nothing; repeated rows and equal texts
are linked; rows with the same id give a row each; a null id is kept and is
never the smallest of a component with other ids; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import common as C
from basketry.llm.components import connected_components

SHINGLE = 5
#: Similarity threshold in percent.
PERCENT = 80
#: Document counts are kept in 2^COUNT_BITS buckets.
COUNT_BITS = 20
#: Prefix entries per group of the index, and sets per part of a frequent shingle.
ENTRIES, PART = 400_000, 20_000
#: Pivots that a set is tried with before all else.
PIVOTS = 2
#: Lists with the same smallest set are worked on together up to so many sets.
HOME = 4096
#: Tasks that the sets of one pivot are dealt to where its name is joined with.
SALTS = 256
#: Bytes of sets per group of lists.
LIST_BYTES = 24 << 20
_ENTRY = np.dtype([("shingle", "<u8"), ("set", "<u8"), ("n", "<i4"), ("place", "<i4")])
#: Counts of a set's shingles in so many classes (up to 255 each) bound any
#: overlap; lists of up to MATRIX sets are cut down by that bound.
CLASSES, MATRIX = 128, 512


def text_sets(data: np.ndarray, offsets: np.ndarray):
    """For a chunk: the distinct shingles of all texts, sorted within each text,
    their bounds (n + 1), and each text's set hash (0: empty)."""
    low = C.LOWER[data]
    starts, ends, first = C.word_bounds(low, offsets, C.NOT_SPACE)
    words = C.word_hashes(low, starts, ends)
    h, at, _ = C.shingle_hashes(words, first, SHINGLE)
    counts, runs = np.diff(first), np.diff(at)
    text = np.repeat(np.arange(len(counts)), runs)
    short = np.flatnonzero((counts > 0) & (runs == 0))
    whole = []
    for i in short.tolist():
        x = np.array([counts[i]], np.uint64)
        for w in words[first[i]:first[i + 1]]:
            x = C.mix(x * np.uint64(31) + w)
        whole.append(x)
    if whole:
        h, text = np.concatenate([h, *whole]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    edges = np.searchsorted(text, np.arange(len(counts) + 1)).tolist()
    for a, b in zip(edges[:-1], edges[1:]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    bounds = np.searchsorted(text, np.arange(len(counts) + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C.mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(bounds)
    key = C.mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64))
    return h, bounds, np.where(n > 0, np.where(key == 0, np.uint64(1), key), np.uint64(0))


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _scan(batches):
    """One row per text (its set and size) and, at the end of the partition,
    the shingle counts of its texts in 64 parts."""
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    names = ["doc_id", "set", "n", "classes", "part", "counts"]
    id_type = None
    for batch in batches:
        id_type = batch.schema.field(0).type
        sets, sizes, classes = [], [], []
        for _, data, offsets in C.chunks(batch.column(1)):
            h, bounds, key = text_sets(data, offsets)
            counts += np.bincount(_buckets(h), minlength=1 << COUNT_BITS)
            sets.append(key.view(np.int64))
            sizes.append(np.diff(bounds))
            text = np.repeat(np.arange(len(key)), sizes[-1])
            per = np.bincount(text * CLASSES + (h % np.uint64(CLASSES)).astype(np.int64), minlength=len(key) * CLASSES)
            classes += [x.tobytes() for x in np.minimum(per, 255).astype(np.uint8).reshape(-1, CLASSES)]
        if sets:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(sets)), pa.array(np.concatenate(sizes)),
                 pa.array(classes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    if id_type is not None:
        parts = [x.astype(np.int32).tobytes() for x in np.split(counts, 64)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(64, id_type), pa.nulls(64, pa.int64()), pa.nulls(64, pa.int64()),
             pa.nulls(64, pa.binary()), pa.array(np.arange(64, dtype=np.int32)), pa.array(parts, pa.binary())], names=names)


def _add_counts(key, table):
    total = np.zeros((1 << COUNT_BITS) // 64, np.int64)
    for x in table["counts"]:
        total += np.frombuffer(x.as_buffer(), np.int32)
    return pa.Table.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()),
                                 "counts": pa.array([total.tobytes()], pa.binary())})


def _bucket_counts(table: DataFrame) -> np.ndarray:
    """The sum of all shingle counts that a stored table holds."""
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for row in (table.where(F.col("part").isNotNull()).select("part", "counts").groupBy("part")
                .applyInArrow(_add_counts, "part int, counts binary").collect()):
        counts.reshape(64, -1)[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return counts


class GlobalOrder:
    """Rarest shingles first: by the count of a shingle's bucket, then by hash."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def of_texts(self, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``h`` is sorted within each text, so a stable sort by count is enough."""
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return h[np.argsort((text << 40) | self.counts[_buckets(h)], kind="stable")]


class Parts:
    """Parts that a shingle's sets are dealt out to, by the number of distinct
    sets with a shingle of its bucket in their prefix."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.size = counts, PART
        mean = counts.mean() if len(counts) else 0.0
        self.noise = mean + 8 * np.sqrt(mean)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        return 1 + (np.maximum(self.counts[_buckets(shingles)] - self.noise, 0) // self.size).astype(np.int64)


def least_overlap(a, b, percent: int = PERCENT):
    """Overlap that sets of sizes a and b need."""
    return -(-percent * (a + b) // (100 + percent))


def _prefixes(shared):
    """A row (set, n, prefix) per text: the first shingles of its ordered set."""
    def run(batches):
        order = shared.value
        for batch in batches:
            for _, data, offsets in C.chunks(batch.column(0)):
                h, bounds, key = text_sets(data, offsets)
                h = order.of_texts(h, bounds)
                n = np.diff(bounds)
                prefix = np.where(n > 0, n - (-(-PERCENT * n // 100)) + 1, 0)
                # a copy within the chunk is left out at once
                first = np.unique(key, return_index=True)[1]
                first = first[key[first] != 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first].view(np.int64)), pa.array(n[first]),
                     pa.array([h[a:a + k].tobytes() for a, k in zip(bounds[first].tolist(), prefix[first].tolist())],
                              pa.binary())], names=["set", "n", "prefix"])
    return run


def _count_prefixes(batches):
    """The rows as they are and, at the end of the partition, the counts of
    their prefix shingles in 64 parts."""
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    names, some = ["set", "n", "prefix", "part", "counts"], False
    for batch in batches:
        some, m = True, batch.num_rows
        h = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(2)), np.uint64)
        np.add.at(counts, _buckets(h), 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
    if some:
        parts = [x.astype(np.int32).tobytes() for x in np.split(counts, 64)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(64, pa.int64()), pa.nulls(64, pa.int64()), pa.nulls(64, pa.binary()),
             pa.array(np.arange(64, dtype=np.int32)), pa.array(parts, pa.binary())], names=names)


def _index(shared, groups: int):
    """Rows (part, entries): the prefix entries of all sets, dealt out by shingle."""
    def flush(held):
        x = np.concatenate(held)
        part = (C.mix(x["shingle"]) % np.uint64(groups)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        x, part = x[order], part[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(x)]])
        keep = [(int(part[a]), x[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:]) if b > a]
        return pa.RecordBatch.from_pydict({"part": pa.array([k for k, _ in keep], pa.int32()),
                                           "entries": pa.array([v for _, v in keep], pa.binary())})

    def run(batches):
        parts_of, held, size = shared.value, [], 0
        for batch in batches:
            h = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(2)), np.uint64)
            prefix = np.array([len(x.as_buffer()) // 8 for x in batch.column(2)], np.int64)
            text = np.repeat(np.arange(len(prefix)), prefix)
            x = np.zeros(len(text), _ENTRY)
            x["shingle"], x["set"] = h, batch.column(0).to_numpy().view(np.uint64)[text]
            x["n"], x["place"] = batch.column(1).to_numpy()[text], np.arange(len(text)) - (np.cumsum(prefix) - prefix)[text]
            parts = parts_of(x["shingle"])
            many = np.flatnonzero(parts > 1)
            if len(many):
                # every pair of parts is a cell, with a shingle of its own
                cells = np.repeat(x[many], parts[many])
                width = np.repeat(parts[many], parts[many])
                other = np.arange(len(cells)) - np.repeat(np.cumsum(parts[many]) - parts[many], parts[many])
                own = (cells["set"] % width.astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(own, other), np.maximum(own, other)
                cells["shingle"] = C.mix(cells["shingle"] + C.mix((low * width + high + 1).astype(np.uint64)))
                x = np.concatenate([np.delete(x, many), cells])
            held.append(x)
            size += len(x)
            if size >= 1_000_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)
    return run


def _lists(key, table):
    """The distinct lists of sets that share a prefix shingle, cut where the
    next larger set is too large to link."""
    x = np.concatenate([np.frombuffer(e.as_buffer(), _ENTRY) for e in table["entries"]])
    x = x[np.argsort(x["shingle"], kind="stable")]
    same = x["shingle"][1:] == x["shingle"][:-1]
    x = x[np.append(False, same) | np.append(same, False)]
    x = x[np.lexsort((x["set"], x["n"], x["shingle"]))]
    x = x[np.append(True, (x["shingle"][1:] != x["shingle"][:-1]) | (x["set"][1:] != x["set"][:-1]))[:len(x)]]
    start = np.ones(len(x), bool)
    start[1:] = ((x["shingle"][1:] != x["shingle"][:-1])
                 | (100 * x["n"][:-1].astype(np.int64) < PERCENT * x["n"][1:].astype(np.int64)))
    edges = np.append(np.flatnonzero(start), len(x))
    # a pair whose first common shingle this is cannot overlap by more than the rest
    pairs = np.flatnonzero(np.diff(edges) == 2)
    n, rest = x["n"].astype(np.int64), (x["n"] - x["place"]).astype(np.int64)
    a = edges[pairs]
    hopeless = pairs[np.minimum(rest[a], rest[a + 1]) < least_overlap(n[a], n[a + 1])] if len(pairs) else pairs
    several = np.diff(edges) > 1
    several[hopeless] = False
    found = {}
    for i in np.flatnonzero(several):
        members = x["set"][edges[i]:edges[i + 1]]
        found[members.tobytes()] = members
    rows = list(found.values())
    names = [int(C.mix(np.cumsum(C.mix(m))[-1:] + np.uint64(len(m))).view(np.int64)[0]) for m in rows]
    return pa.Table.from_pydict({"list": pa.array(names, pa.int64()),
                                 "sets": pa.array([m.view(np.int64) for m in rows], pa.list_(pa.int64()))})


class Trie:
    """Ordered sets (arrays of ranks, ascending) with shared prefixes stored
    once. A node is (label, depth behind it, least and most set size below, sets
    that end in it, children, sets below)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.roots: list = []
        todo = [(sorted(range(len(sets)), key=lambda i: sets[i].tolist()), 0, self.roots)]
        while todo:
            members, depth, nodes = todo.pop()
            for group in self._groups(members, depth):
                a, b = sets[group[0]], sets[group[-1]]
                n = min(len(a), len(b))
                differ = np.flatnonzero(a[depth:n] != b[depth:n])
                # the ends of a sorted group agree no further than any two between
                stop = depth + int(differ[0]) if len(differ) else n
                sizes = [len(sets[m]) for m in group]
                children: list = []
                below = [m for m, size in zip(group, sizes) if size > stop]
                nodes.append((a[depth:stop], stop, min(sizes), max(sizes),
                              [m for m, size in zip(group, sizes) if size == stop], children, group))
                if below:
                    todo.append((below, stop, children))

    def _groups(self, members: list[int], depth: int):
        """Runs of sorted sets with the same rank at ``depth``."""
        i = 0
        while i < len(members):
            j, rank = i + 1, self.sets[members[i]][depth]
            while j < len(members) and self.sets[members[j]][depth] == rank:
                j += 1
            yield members[i:j]
            i = j

    def link(self, probe: np.ndarray, ranks: int, skip, link) -> None:
        """Call ``link(member)`` for the sets that link with ``probe``.
        ``skip(members)``: whether these need no visit; asked as the walk goes on."""
        n = len(probe)
        held = np.zeros(ranks, bool)
        held[probe] = True
        passed = np.concatenate([[0], np.cumsum(held)])
        stack = [(node, 0) for node in self.roots]
        while stack:
            (label, depth, least, most, here, children, group), overlap = stack.pop()
            if 100 * most < PERCENT * n or PERCENT * least > 100 * n or skip(group):
                continue
            overlap += int(held[label].sum())
            left = min(n - int(passed[label[-1] + 1]), most - depth)
            if overlap + left < least_overlap(n, max(least, -(-PERCENT * n // 100))):
                continue
            for m in here:
                if 100 * overlap >= PERCENT * (n + len(self.sets[m]) - overlap) and not skip([m]):
                    link(m)
            stack += [(child, overlap) for child in children]


class Links:
    """Links found so far in a group of lists, and the components they make."""

    def __init__(self, names: np.ndarray, roots: np.ndarray):
        self.node = dict(zip(names.tolist(), roots.tolist()))
        self.parent: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def find(self, name: int) -> int:
        x, parent = self.node[name], self.parent
        while x in parent:
            up = parent[x]
            if up in parent:
                parent[x] = parent[up]
            x = up
        return x

    def add(self, a: int, b: int) -> None:
        self.found.append((a, b))
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[x] = y


def list_links(names: list[int], sets: list[np.ndarray], probes: list[bool], order: GlobalOrder, links: Links) -> None:
    """Add the links that connect the sets of one list, as far as its probes go."""
    if len({links.find(n) for n in names}) == 1:
        return
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    distinct, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.empty(len(distinct), np.int64)
    place[np.lexsort((distinct, order.counts[_buckets(distinct)]))] = np.arange(len(distinct))
    ranked = [np.sort(place[ranks[a:b]]) for a, b in zip(at[:-1], at[1:])]
    trie = Trie(ranked)
    for p in np.flatnonzero(probes).tolist():
        def skip(members):
            own = links.find(names[p])
            return all(links.find(names[m]) == own for m in members)

        trie.link(ranked[p], len(distinct), skip, lambda m: links.add(names[p], names[m]))


def _join_lists(shared):
    """Links (a, b) of the lists of a group: rows with shingles give the sets,
    rows with a list its members."""
    def run(key, table):
        order = shared.value
        held = np.asarray(table["shingles"].is_valid())
        given = table.filter(pa.array(held))
        sets = {n: np.frombuffer(x.as_buffer(), np.uint64)
                for n, x in zip(given["set"].to_pylist(), given["shingles"])}
        rows = table.filter(pa.array(~held)).sort_by([("list", "ascending"), ("set", "ascending")])
        lists, names = rows["list"].to_numpy(), rows["set"].to_numpy()
        probes = np.asarray(rows["probe"])
        links = Links(names, rows["root"].to_numpy())
        edges = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                own = names[a:b].tolist()
                list_links(own, [sets[n] for n in own], probes[a:b].tolist(), order, links)
        return pa.Table.from_pydict({"a": pa.array([x[0] for x in links.found], pa.int64()),
                                     "b": pa.array([x[1] for x in links.found], pa.int64())})
    return run


def _possible(key, table):
    """The members of each list that have a possible partner, by their sizes and
    class counts, and the list's smallest member."""
    table = table.sort_by([("list", "ascending"), ("set", "ascending")])
    lists, n = table["list"].to_numpy(), table["n"].to_numpy()
    classes = np.frombuffer(b"".join(x.as_buffer() for x in table["classes"]), np.uint8).reshape(-1, CLASSES)
    full = (classes == 255).any(axis=1)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])
    keep = np.zeros(len(lists), bool)

    def possible(i, j):
        shared = np.minimum(classes[i], classes[j]).sum(axis=-1, dtype=np.int64)
        return full[i] | full[j] | (shared >= least_overlap(n[i], n[j]))

    size = np.diff(edges)
    two = edges[:-1][size == 2]
    keep[two] = keep[two + 1] = possible(two, two + 1)
    for a, b in zip(edges[:-1][size > 2].tolist(), edges[1:][size > 2].tolist()):
        if b - a > MATRIX:
            keep[a:b] = True
        else:
            rows = np.arange(a, b)
            keep[a:b] = [possible(i, rows[rows != i]).any() for i in range(a, b)]
    left, kept_lists = table["set"].to_numpy()[keep], lists[keep]
    first = np.append(True, kept_lists[1:] != kept_lists[:-1])[:len(left)]
    low = left[first][np.cumsum(first) - 1] if len(left) else left
    return pa.Table.from_pydict({"list": pa.array(kept_lists), "set": pa.array(left), "low": pa.array(low)})


def _sets_of(shared):
    """(doc_id, set, shingles) of the documents that a bit table lets through."""
    def run(batches):
        let_through = shared.value
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            batch = batch.filter(pa.array(let_through(hashes)))
            names, found = [], []
            for _, data, offsets in C.chunks(batch.column(2)):
                h, bounds, key = text_sets(data, offsets)
                names.append(key.view(np.int64))
                found += [h[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            if names:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array(np.concatenate(names)), pa.array(found, pa.binary())],
                    names=["doc_id", "set", "shingles"])
    return run


def _with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` (low, set, ..) with the columns that ``marks`` gives some pivots (low). A
    pivot's rows go to SALTS places by their sets; ``marks`` holds at most a row for each
    HOME / 2 rows, so its copies stay below the rows."""
    salt = F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")
    copies = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copies, ["low", "salt"], "left").drop("salt")


def _links_of(docs: DataFrame, members: DataFrame, chosen: DataFrame, shared, name: str) -> DataFrame:
    """Links within lists; ``members`` has (list, low, set, root, probe),
    ``chosen`` one document of each set. Lists with the same smallest set (low)
    are joined into one, unless that would hold too many sets, so that no pair is
    compared in list after list; and a set goes once to each group of lists."""
    spark = docs.sparkSession
    members = C.stored(members, f"{name}_members")
    if members.isEmpty():
        return members.select(F.col("set").alias("a"), F.col("set").alias("b"))
    many = (members.select("low", "set").distinct().groupBy("low").count().where(F.col("count") > HOME)
            .select("low", F.lit(True).alias("many")))
    members = _with_marks(members, many).withColumn(
        "home", F.when(F.col("many"), F.col("list")).otherwise(F.col("low")))
    needed = C.stored(members.select("set").distinct().join(chosen, "set"), f"{name}_sets")
    total = members.select("home", "set").distinct().join(needed, "set").agg(F.sum(8 * F.col("n"))).collect()[0][0] or 0
    groups = max(1, -(-int(total) // LIST_BYTES))
    group = F.pmod(F.xxhash64("home"), F.lit(groups)).cast("int").alias("group")
    bits = spark.sparkContext.broadcast(C.BitTable(needed.select(F.xxhash64("chosen"))))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sets = (docs.select(F.xxhash64("doc_id").alias("hash"), "doc_id", "text")
            .mapInArrow(_sets_of(bits), f"doc_id {id_type}, set long, shingles binary").alias("s"))
    wanted = members.select(group, "set").distinct().join(needed, "set").alias("w")
    payload = (wanted.join(sets, (F.col("w.set") == F.col("s.set")) & F.col("w.chosen").eqNullSafe(F.col("s.doc_id")))
               .select("group", "w.set", "shingles"))
    rows = members.groupBy("home", "set").agg(F.min("root").alias("root"), F.max("probe").alias("probe")).select(
        group, F.col("home").alias("list"), "set", "root", "probe")
    both = rows.unionByName(payload, allowMissingColumns=True)
    links = C.stored(both.groupBy("group").applyInArrow(_join_lists(shared), "a long, b long"), f"{name}_links")
    bits.destroy()
    return links


def _stars(tried: DataFrame) -> DataFrame:
    """The lists of pivots: each set of ``tried`` (low, set) with its pivot low,
    which alone probes. The sets of a pivot that many have are dealt out to
    lists of about HOME / 2, and the pivot is sent to each, so no link is lost."""
    tried = C.stored(tried, "tried")
    hot = tried.groupBy("low").count().where(F.col("count") >= HOME).select(
        "low", F.ceil(F.col("count") * 2 / HOME).cast("long").alias("chunks"))
    dealt = _with_marks(tried, hot).select(
        "low", "set", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("set"), "chunks")).alias("chunk"))
    pivots = tried.select("low").distinct().join(hot, "low", "left").select(
        "low", F.col("low").alias("set"),
        F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(None).cast("long")))
                  .otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).alias("chunk"))
    name = F.when(F.col("chunk").isNull(), F.col("low")).otherwise(F.xxhash64("low", "chunk"))
    return dealt.union(pivots).select(
        name.alias("list"), "low", "set", F.col("set").alias("root"), (F.col("set") == F.col("low")).alias("probe"))


def jaccard_components(docs: DataFrame, merge: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach; ``merge`` as in
    ``connected_components``."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scanned = C.stored(docs.mapInArrow(
        _scan, f"doc_id {id_type}, set long, n long, classes binary, part int, counts binary"), "jaccard_sets")
    texts = scanned.where(F.col("part").isNull()).select("doc_id", "set", "n", "classes")
    order = spark.sparkContext.broadcast(GlobalOrder(_bucket_counts(scanned)))
    prefixes = C.stored(docs.select("text").mapInArrow(_prefixes(order), "set long, n long, prefix binary")
                        .dropDuplicates(["set"])
                        .mapInArrow(_count_prefixes, "set long, n long, prefix binary, part int, counts binary"),
                        "jaccard_prefixes")
    counts = _bucket_counts(prefixes)
    parts = spark.sparkContext.broadcast(Parts(counts))
    groups = max(1, int(counts.sum()) // ENTRIES)
    lists = C.stored(prefixes.where(F.col("part").isNull()).select("set", "n", "prefix")
                     .mapInArrow(_index(parts, groups), "part int, entries binary")
                     .groupBy("part").applyInArrow(_lists, "list long, sets array<long>")
                     .dropDuplicates(["list"]), "jaccard_lists")
    filled = texts.where(F.col("set") != 0)
    chosen = filled.groupBy("set").agg(F.min("doc_id").alias("chosen"), F.max("n").alias("n"))
    counted = filled.groupBy("set").agg(F.max("n").alias("n"), F.first("classes").alias("classes"))

    # the members with a possible partner
    member = F.explode("sets").alias("set")
    groups = max(1, int(lists.agg(F.sum(F.size("sets"))).collect()[0][0] or 0) * 2 * CLASSES // LIST_BYTES)
    members = C.stored(lists.select("list", member).join(counted, "set")
                       .withColumn("group", F.pmod(F.xxhash64("list"), F.lit(groups)).cast("int"))
                       .groupBy("group").applyInArrow(_possible, "list long, set long, low long"), "jaccard_members")

    # each set with some of the smallest sets of its lists
    place = F.row_number().over(Window.partitionBy("set").orderBy("low"))
    tried = (members.where(F.col("set") != F.col("low")).select("low", "set").distinct()
             .withColumn("place", place).where(F.col("place") <= PIVOTS).select("low", "set"))
    stars = _stars(tried)
    found = _links_of(docs, stars, chosen, order, "star")
    roots = connected_components(found, merge)

    # the lists that are not connected by now: all but the largest component probe
    joined = (members.join(roots, F.col("set") == F.col("node"), "left")
              .select("list", "low", "set", F.coalesce("root", "set").alias("root")))
    sizes = joined.groupBy("list", "root").count()
    split = sizes.groupBy("list").agg(F.count("*").alias("roots"), F.max(F.struct("count", "root")).alias("most"))
    rest = joined.join(split.where("roots > 1").select("list", F.col("most.root").alias("largest")), "list").select(
        "list", "low", "set", "root", (F.col("root") != F.col("largest")).alias("probe"))
    rest = _links_of(docs, rest, chosen, order, "list")
    # all that reads them is stored by now
    order.destroy()
    parts.destroy()
    if not rest.isEmpty():
        roots = connected_components(found.union(rest), merge)

    of_set = (chosen.join(roots, F.col("set") == F.col("node"), "left")
              .select("set", F.coalesce("root", "set").alias("root"), "chosen"))
    least = of_set.groupBy("root").agg(F.min("chosen").alias("component_id"))
    named = of_set.join(least, "root").select("set", "component_id")
    return texts.drop("classes").join(named, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"))
