r"""Conversation structure repair by generalised LR parsing with edits.

The role grammar makes an LR table. A parse stack is a cell: a table state on the
cell below it, and equal stacks are one cell, so all live stacks form one graph that
shares their lower parts. Each row may be kept, given another role or deleted, and a
turn may be inserted anywhere, each at a price; every edit moves a stack to other
cells, and stacks that meet in one cell merge by the least (cost, audit), the audit
being the edits' letters in order. The cheapest accepted stack names the repair.

A conversation of any length is spread over tasks: rows are sorted by conversation
and turn over range partitions and cut into blocks of at most ``BLOCK_ROWS`` rows.
A block that may begin in the middle of a conversation is parsed from every cell of the
grammar. A short table of costs from cell to cell, without texts, then chains
the blocks of a conversation, and the chosen way of each block is applied to its
rows. Only the digest of a whole repaired conversation gathers its lines, since
one hash goes over all of them.

Edits, by letter: K keep, R rerole to user or assistant, D delete, I insert an
empty turn. Faults of a row, the first that holds: blank, duplicate (role and
text stand earlier in the conversation), truncated (the last character that is
no white space ends no sentence). Blank and duplicate rows must be deleted.

Defined results: rows are ordered by turn (null first), then role, then a hash of
the text, so that equal rows are neighbours; a role or text that is null is one space; a
null conv_id names one conversation; roles beyond the grammar can only be reroled or deleted;
a conversation without rows has no edits; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm import common as C

#: Rules of the grammar over role initials; chat: s?(ua)+ or nothing.
GRAMMAR = {"chat": ((), ("turns",), ("s", "turns")),
           "turns": (("pair",), ("turns", "pair")),
           "pair": (("u", "a"),)}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20
MOST_CELLS = 1_000
END = "$"
SPACES = r"[\x20\x09-\x0D]"


# --------------------------------------------------------------------------
# Table and stacks
# --------------------------------------------------------------------------

class Table:
    """LR states of a grammar, their moves, and the reductions that the tokens
    which may follow a rule's left side allow."""

    def __init__(self, grammar: dict[str, tuple], start: str):
        self.rules = [("", (start, END))] + [(left, right) for left, rights in grammar.items() for right in rights]
        nullable = set()
        while more := {l for l, r in self.rules if l not in nullable and all(x in nullable for x in r)}:
            nullable |= more

        def grown(sets: dict[str, set], step) -> dict[str, set]:
            size = -1
            while size != (size := sum(map(len, sets.values()))):
                for left, right in self.rules:
                    step(sets, left, right)
            return sets

        def first(sets, left, right):
            for x in right:
                sets[left] |= sets[x] if x in sets else {x}
                if x not in nullable:
                    break

        firsts = grown({left: set() for left, _ in self.rules}, first)

        def follow(sets, left, right):
            after = set(sets[left])
            for x in reversed(right):
                if x in sets:
                    sets[x] |= after
                    after = firsts[x] | (after if x in nullable else set())
                else:
                    after = {x}

        follows = grown({left: set() for left, _ in self.rules}, follow)

        def closed(items):
            items = set(items)
            while more := {(k, 0) for r, dot in items for x in self.rules[r][1][dot:dot + 1]
                           for k, (left, _) in enumerate(self.rules) if left == x} - items:
                items |= more
            return frozenset(items)

        states = [closed({(0, 0)})]
        self.moves, self.reductions = {}, {}
        for n, items in enumerate(states):
            for symbol in sorted({x for r, dot in items for x in self.rules[r][1][dot:dot + 1]}):
                to = closed({(r, dot + 1) for r, dot in items if self.rules[r][1][dot:dot + 1] == (symbol,)})
                if to not in states:
                    states.append(to)
                self.moves[n, symbol] = states.index(to)
            for r, dot in items:
                left, right = self.rules[r]
                if r and dot == len(right):
                    for token in follows[left]:
                        self.reductions.setdefault((n, token), []).append((left, len(right)))


class Stacks:
    """The graph of parse stacks: cell number -> (state, cell below). Equal stacks
    are one cell; cell 0 is the empty stack."""

    def __init__(self, table: Table):
        self.table, self.cells, self.number, self.fed = table, [(0, -1)], {(0, -1): 0}, {}

    def _on(self, state: int, below: int) -> int:
        at = self.number.setdefault((state, below), len(self.cells))
        if at == len(self.cells):
            self.cells.append((state, below))
        return at

    def feed(self, cell: int, token: str) -> tuple[int, ...]:
        """The cells after all reductions that ``token`` allows and its shift."""
        if (cell, token) not in self.fed:
            todo, seen, out = [cell], {cell}, []
            while todo:
                at = todo.pop()
                state = self.cells[at][0]
                for left, size in self.table.reductions.get((state, token), ()):
                    base = at
                    for _ in range(size):
                        base = self.cells[base][1]
                    reduced = self._on(self.table.moves[self.cells[base][0], left], base)
                    if reduced not in seen:
                        seen.add(reduced)
                        todo.append(reduced)
                if (state, token) in self.table.moves:
                    out.append(self._on(self.table.moves[state, token], at))
            self.fed[cell, token] = tuple(sorted(set(out)))
        return self.fed[cell, token]

    def reachable(self) -> list[int]:
        """All cells that role initials can lead to: few, as lists of the grammar
        recurse on the left."""
        found, todo = [0], [0]
        tokens = sorted({t for (_, t) in self.table.moves if len(t) == 1 and t != END})
        while todo:
            cell = todo.pop()
            for token in tokens:
                for to in self.feed(cell, token):
                    if len(found) > MOST_CELLS:
                        raise ValueError("the grammar's stacks grow without bound: let its lists recurse on the left")
                    if to not in found:
                        found.append(to)
                        todo.append(to)
        return sorted(found)


Front = dict[int, tuple[int, str]]


class Repair:
    """Cheapest edits of runs of rows, from any stack to any stack."""

    def __init__(self, grammar=GRAMMAR, start: str = "chat"):
        self.stacks = Stacks(Table(grammar, start))
        self.starts = self.stacks.reachable()

    @staticmethod
    def _merge(front: Front, cell: int, cost: int, audit: str) -> bool:
        if cell in front and front[cell] <= (cost, audit):
            return False
        front[cell] = (cost, audit)
        return True

    def inserted(self, front: Front) -> Front:
        """``front`` and all that inserted turns lead to."""
        front, todo = dict(front), list(front)
        while todo:
            cell = todo.pop(0)
            cost, audit = front[cell]
            for token in ROLES:
                for to in self.stacks.feed(cell, token):
                    if self._merge(front, to, cost + INSERT, audit + "I"):
                        todo.append(to)
        return front

    def row(self, front: Front, initial: str, fault: int) -> Front:
        """The stacks behind one more row; turns are inserted before it only."""
        out: Front = {}
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        for cell, (cost, audit) in self.inserted(front).items():
            self._merge(out, cell, cost + DELETE, audit + "D")
            if fault in (BLANK, DUPLICATE):
                continue
            for to in self.stacks.feed(cell, initial) if initial else ():
                self._merge(out, to, cost + KEEP + more, audit + "K")
            for token in ROLES:
                for to in self.stacks.feed(cell, token):
                    self._merge(out, to, cost + REROLE + more, audit + "R")
        return out

    def ways(self, rows: list[tuple[str, int]], start: int) -> Front:
        """(cost, audit) from ``start`` through all rows to every end."""
        front: Front = {start: (0, "")}
        for initial, fault in rows:
            front = self.row(front, initial, fault)
        return front

    @lru_cache(maxsize=None)
    def ending(self, cell: int) -> tuple[int, str] | None:
        """(cost, audit) of the insertions from ``cell`` to an accepted stack."""
        ends = [way for at, way in self.inserted({cell: (0, "")}).items() if self.stacks.feed(at, END)]
        return min(ends, default=None)

    def applied(self, start: int, audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """The (role, text) turns that an audit makes of its rows."""
        out, cell, rows = [], start, iter(rows)
        for letter in audit:
            role, text = next(rows) if letter != "I" else ("", "")
            if letter == "D":
                continue
            tokens = (role[:1],) if letter == "K" else ROLES
            cell, token = next((to, t) for t in tokens for to in self.stacks.feed(cell, t))
            out.append((role if letter == "K" else ROLES[token], text))
        return out


_repairs: list[Repair] = []


def _repair() -> Repair:
    if not _repairs:
        _repairs.append(Repair())
    return _repairs[0]


# --------------------------------------------------------------------------
# Rows, blocks and chains
# --------------------------------------------------------------------------

def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a damaged copy, by the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    sentence ends away, 3 repeats it, 4 makes it the user's."""
    way = F.pmod(F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))), F.lit(20))
    text = (F.when(way == 1, F.lit("")).when(way == 2, F.regexp_replace(_spaced("text"), "[.!?]", ""))
            .otherwise(_spaced("text")))
    role = F.when(way == 4, F.lit("user")).otherwise(_spaced("role"))
    copies = F.array_repeat(F.lit(0), F.when(way == 0, F.lit(0)).when(way == 3, F.lit(2)).otherwise(F.lit(1)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with ``tie``, their order within a turn and
    role, and ``fault`` (0: none). Equal rows meet by a hash of role and text, so the rows of a
    long conversation are spread over the tasks."""
    rows = rows.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"))
    same = Window.partitionBy("conv_id", "digest", "tie").orderBy("turn")
    rows = rows.withColumns({"tie": F.xxhash64("text"), "digest": F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)})
    rows = rows.withColumn("nth", F.row_number().over(same))
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){SPACES}*\z", 1)
    fault = (F.when(last == "", BLANK).when(F.col("nth") > 1, DUPLICATE)
             .when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0))
    return rows.select("conv_id", "turn", "role", "text", "tie", fault.alias("fault"))


_TURNS = "array<struct<role string, text string>>"
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
_LEGAL = {"su", "ua", "au"}


def _block_schema(conv: str) -> str:
    return (f"conv_id {conv}, part int, block int, opens boolean, ways string, edges string, first_turn long, last_turn long, "
            f"{', '.join(f'{c} long' for c in _COUNTS)}, given {_TURNS}")


def _block(rows: list[tuple], opens: bool) -> tuple:
    """Ways, edge roles, turns, counts and rows of a block of (turn, role, text, fault)."""
    repair = _repair()
    coded = [(r[1][:1], r[3]) for r in rows]
    ways = {s: {e: list(w) for e, w in repair.ways(coded, s).items()} for s in ([0] if opens else repair.starts)}
    initials = [c[0] for c in coded]
    turns = [r[0] for r in rows if r[0] is not None]
    fault = [r[3] for r in rows]
    counts = (len(rows), fault.count(BLANK), fault.count(DUPLICATE), fault.count(TRUNCATED),
              sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), len(set(turns)))
    return (json.dumps(ways), json.dumps([initials[0], initials[-1]]), min(turns, default=None), max(turns, default=None),
            *counts, [{"role": r[1], "text": r[2]} for r in rows])


def _blocks(schema: pa.Schema):
    """Worker function: blocks of a partition sorted by conversation and turn. Only a
    partition's first conversation may have begun before."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    def cut(batches):
        """(conv_id, opens, rows, characters) of each block."""
        held, chars, conv, opens = [], 0, None, False
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (own != conv or len(held) >= BLOCK_ROWS or chars + len(row[2]) > BLOCK_CHARS):
                    yield conv, opens, held, chars
                    opens = own != conv
                    held, chars = [], 0
                conv = own
                held.append(tuple(row))
                chars += len(row[2])
        if held:
            yield conv, opens, held, chars

    def run(batches):
        part, out, size = TaskContext.get().partitionId(), [], 0
        for block, (conv, opens, rows, chars) in enumerate(cut(batches)):
            out.append((conv, part, block, opens, *_block(rows, opens)))
            size += chars
            if len(out) >= C.BATCH_ROWS or size > BLOCK_CHARS:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    return run


def repair_blocks(rows: DataFrame) -> DataFrame:
    """The written table of blocks: given rows, counts, and the cost and audit
    from every cell in which the block may start to every cell in which it may end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    C.small_batches(rows.sparkSession)
    conv = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "tie"]
    dealt = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
             .select("conv_id", F.col("turn").cast("long"), "role", "text", "fault"))
    empty = rows.sparkSession.createDataFrame([], _block_schema(conv))
    return C.stored(dealt.mapInArrow(_blocks(to_arrow_schema(empty.schema)), empty.schema), "blocks")


def _chain(blocks: list[dict]) -> list[dict]:
    """The cheapest way through the blocks of one conversation in order: per block the
    start, the audit's rank among the block's ways from there, the cost, the insertions behind
    the last block, and what the edge to the block before adds to the counts."""
    repair = _repair()
    # least cost from each cell before a block to an accepted end
    rest: dict[int, int] = {c: e[0] for c in repair.starts if (e := repair.ending(c))}
    after = [rest]
    for b in reversed(blocks):
        rest = {int(s): min(w + rest[int(e)] for e, (w, _) in ends.items() if int(e) in rest)
                for s, ends in b["ways"].items() if any(int(e) in rest for e in ends)}
        after.append(rest)
    after.reverse()
    out, cell, before = [], 0, None
    for k, b in enumerate(blocks):
        ends = {int(e): w for e, w in b["ways"][str(cell)].items()}
        # ways of equal cost to the end of the conversation: the least audit. No audit is
        # the beginning of another, as each ends in the letter of the block's last row.
        rank, end = min((way[1], e) for e, way in ends.items()
                        if e in after[k + 1] and way[0] + after[k + 1][e] == after[k][cell])
        cost, tail = ends[end][0], ""
        if k + 1 == len(blocks):
            more, tail = repair.ending(end)
            cost += more
        out.append({"conv_id": b["conv_id"], "part": b["part"], "block": b["block"], "start": cell, "rank": rank, "cost": cost, "tail": tail,
                    "seam_illegal": int(before is not None and before["edges"][1] + b["edges"][0] not in _LEGAL),
                    "seam_turns": -int(before is not None and b["first_turn"] is not None
                                       and before["last_turn"] == b["first_turn"])})
        before, cell = b, end
    return out


def _ranked(ways: dict[str, dict[str, list]]) -> tuple[dict, dict]:
    """Ways with each audit replaced by its place among the audits from the same
    start, and the audits themselves in that order."""
    ranks, audits = {}, {}
    for start, ends in ways.items():
        audits[start] = sorted({a for _, a in ends.values()})
        ranks[start] = {e: [w, audits[start].index(a)] for e, (w, a) in ends.items()}
    return ranks, audits


_CHOSEN = "part int, block int, start int, rank int, cost long, tail string, seam_illegal long, seam_turns long"


def chosen_ways(blocks: DataFrame) -> DataFrame:
    """The way chosen for every block. Only costs from cell to cell travel
    (some hundred bytes a block of ``BLOCK_ROWS`` rows), no texts and no audits; a
    task holds those of one conversation at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    conv = blocks.schema["conv_id"].dataType.simpleString()
    chosen = blocks.sparkSession.createDataFrame([], f"conv_id {conv}, {_CHOSEN}").schema
    schema = to_arrow_schema(chosen)

    def compact(batches):
        for batch in batches:
            ways = [json.dumps(_ranked(json.loads(w))[0]) for w in batch.column(3).to_pylist()]
            yield batch.set_column(3, "ways", pa.array(ways, pa.string()))

    def chains(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                b["ways"], b["edges"] = json.loads(b["ways"]), json.loads(b["edges"])
                if held and held[0]["conv_id"] != b["conv_id"]:
                    out += _chain(held)
                    held = []
                held.append(b)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist(_chain(held), schema=schema)

    steps = blocks.select("conv_id", "part", "block", "ways", "edges", "first_turn", "last_turn")
    return (steps.mapInArrow(compact, steps.schema).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
            .mapInArrow(chains, chosen))


def repaired_blocks(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each block with its ``cost``, its ``audit`` and ``repaired``, its turns
    after the edits."""
    own = chosen.select(F.col("conv_id").alias("own"), F.col("part").alias("p"), F.col("block").alias("b"),
                        "start", "rank", "cost", "tail", "seam_illegal", "seam_turns")
    both = blocks.join(own, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b"))
                       & F.col("conv_id").eqNullSafe(F.col("own"))).drop("own", "p", "b")
    kept = [c for c in both.columns if c not in ("ways", "given", "edges", "start", "rank", "tail")]
    schema = both.select(*kept).schema.add("audit", "string")
    need = both.select(*kept, "ways", "start", "rank", "tail", "given")

    def run(batches):
        for batch in batches:
            audits, turns = [], []
            for ways, start, rank, tail, given in zip(*(batch.column(c).to_pylist() for c in range(len(kept), len(kept) + 5))):
                audits.append(_ranked(json.loads(ways))[1][str(start)][rank] + tail)
                rows = [(g["role"], g["text"]) for g in given]
                turns.append([{"role": r, "text": t} for r, t in _repair().applied(start, audits[-1], rows)])
            kind = batch.schema.field(len(kept) + 4).type
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(audits, pa.string()), pa.array(turns, kind)],
                                             names=[*kept, "audit", "repaired"])

    sql = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return need.mapInArrow(run, f"{sql}, repaired {_TURNS}")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Blocks of repaired conversations: conv_id, place (part, block), counts, cost, audit and
    ``repaired`` turns. In order of place they are the whole conversation."""
    blocks = repair_blocks(faults(rows))
    return repaired_blocks(blocks, chosen_ways(blocks))


def repair_report(conversations: DataFrame) -> DataFrame:
    """A row per conversation of the undamaged table: what the damage left, and
    cost, audit and digest of its repair."""
    pieces = repair_conversations(damaged(conversations))
    line = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    pieces = pieces.withColumn("lines", F.array_join(line, "\n")).withColumn("full", F.size("repaired") > 0)
    ordered = F.sort_array(F.collect_list(F.struct("part", "block", "audit", "full", "lines")))
    whole = F.array_join(F.transform(F.filter("pieces", lambda p: p["full"]), lambda p: p["lines"]), "\n")
    total = lambda *c: F.sum(sum((F.col(x) for x in c[1:]), F.col(c[0])))
    per = pieces.groupBy(F.col("conv_id").alias("own")).agg(
        total("blank").alias("blank"), total("duplicate").alias("duplicate"), total("truncated").alias("truncated"),
        total("illegal", "seam_illegal").alias("illegal"), total("cost").alias("cost"),
        (F.max("last_turn") - F.min("first_turn") + 1 - total("turns", "seam_turns")).alias("gaps"), ordered.alias("pieces"))
    per = per.select("own", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                     F.array_join(F.transform("pieces", lambda p: p["audit"]), "").alias("audit"),
                     F.sha2(whole, 256).alias("repaired_sha256"))
    every = conversations.select("conv_id").distinct()
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
              for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(per, F.col("conv_id").eqNullSafe(F.col("own")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
