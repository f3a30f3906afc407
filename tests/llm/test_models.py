"""Whitening, BPE and conversation repair against brute force, numpy and the
tokenizer library."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from basketry.llm import bpe, repair, whitening
from basketry.llm.queries import VOCABULARY, op12_bpe, op13_conversation_repair
from cases import SF, documents, empty, odd_texts

# --------------------------------------------------------------------------
# BPE
# --------------------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def library_rows(texts):
    t = Tokenizer.from_file(VOCABULARY)
    out = []
    for i, x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return out


def test_bpe_equals_the_library(spark):
    rnd = random.Random(1)
    letters = [*"ab 'stredlvm\n\t.,!?0129é日\U0001f600 <|>\u0085 ½", "<|endoftext|>", "  ", "'ll"]
    texts = odd_texts() + [(100 + i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for i in range(500)]
    texts += [(40, "<|endof"), (41, "text|> of two texts"), (42, "a<|endoftext|><|endoftext|> b"), (43, "ab" * 50_000),
              (44, " " * 30_000 + "x"), (45, "0" * 777)]
    got = bpe.bpe_report(documents(spark, texts), VOCABULARY).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, library_rows(texts)))
    assert bpe.bpe_report(empty(spark), VOCABULARY).count() == 0


def test_bpe_query_equals_the_library(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op12_bpe(spark, SF).collect())) == sorted(library_rows(docs))


def test_short_and_long_pieces_are_cut_alike():
    b, rnd = bpe.Bpe(VOCABULARY), random.Random(2)
    for _ in range(300):
        piece = bytes(rnd.choice(b"abcdetheing\xc3\xa9") for _ in range(rnd.randint(1, 200)))
        ids, bounds = b.scanned(piece)
        assert (ids, bounds) == b.queued(piece)
        assert [piece[x:y] for x, y in zip(bounds, bounds[1:])] == [b.token_bytes[i] for i in ids]


def test_bpe_table_starts_anew_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_PIECES", 3)
    b = bpe.Bpe(VOCABULARY)
    text = "one two three four five six one two"
    assert b.text(text) == Tokenizer.from_file(VOCABULARY).encode(text).ids and len(b._known) <= 3
    ids = spark.createDataFrame([(1, [10 ** 6, -1]), (2, None), (3, []), (4, b.text("é")[:1])], "decode_id int, ids array<int>")
    assert [r.decoded for r in bpe.decode_texts(ids, VOCABULARY).orderBy("decode_id").collect()] == [
        "", None, "", Tokenizer.from_file(VOCABULARY).decode(b.text("é")[:1])]


# --------------------------------------------------------------------------
# Whitening
# --------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x string, n string, component int"


def vector_table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", None, 3) for i, v in vectors], VECTORS)


@pytest.mark.parametrize("width, rank", [(1, 1), (3, 2), (6, 6), (9, 4)])
def test_whitening_against_numpy(spark, width, rank):
    rng = np.random.default_rng(width)
    rows = rng.normal(size=(120, rank)) * 2.0 ** np.arange(rank)
    rows = np.rint(rows @ rng.integers(1, 6, size=(rank, width)) * 8) / 8
    rows = np.vstack([rows, rows[:40], rows[[0] * 50]])
    rows[rows == 0] = -0.0
    vectors = [(i, v) for i, v in enumerate(rows.tolist())]
    vectors += [(900, None), (901, [None] * width), (902, [float("nan")] * width), (903, [float("-inf")] * width),
                (None, rows[3].tolist())]
    got = whitening.whitening_report(vector_table(spark, vectors).repartition(5)).collect()
    x = np.floor(256 * np.float32(rows).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, c = np.linalg.eigh(centred.T @ centred / n)
    e, c = e[::-1], c[:, ::-1]
    k = min(4, int((e > 1e-9 * e[0]).sum()))
    assert {r.n for r in got} == {n} and len(got) == k * (len(rows) + 1)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {(r.vec_id, r.component): r for r in got}
    for j in range(k):
        want = (x - s / n) @ c[:, j] / np.sqrt(e[j])
        have = np.array([by[i, j + 1].whitened for i in range(len(rows))])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert abs(by[0, j + 1].explained - e[j] / e.sum()) < 1e-12
        assert by[None, j + 1].whitened == by[3, j + 1].whitened
    for i, v in enumerate(x.tolist()):
        assert by[i, 1].deviation == sum((n * a - int(b)) ** 2 for a, b in zip(v, s))


def test_whitening_of_odd_tables(spark):
    report = lambda v: whitening.whitening_report(vector_table(spark, v)).collect()
    assert report([]) == [] and report([(1, None)]) == [] and report([(1, []), (2, [])]) == []
    assert report([(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == []
    # a shorter vector is filled up with zeros: (0, 0), (256, 0), (0, 256)
    got = report([(1, []), (2, [1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])])
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(i, 3, d * 256 ** 2) for i, d in ((1, 2), (2, 5), (3, 5), (4, 2))}
    # entries beyond 64 bits saturate; such a deviation is null
    got = report([(1, [1e30]), (2, [-1e30]), (3, [0.0])])
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 1} and len({r.whitened for r in got}) == 3


def test_jacobi_keeps_small_eigenvalues_and_equal_ones():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    for values in (10.0 ** -np.arange(8), np.array([4.0, 4, 4, 1, 1, 1, 1, 1])):
        got, vectors = whitening.eigen((q * values) @ q.T)
        assert np.allclose(got, values, rtol=1e-7) and np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
        assert np.allclose((vectors * got) @ vectors.T, (q * values) @ q.T, atol=1e-14)


# --------------------------------------------------------------------------
# Conversation repair
# --------------------------------------------------------------------------

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """The least (cost, audit) by best-first search over (rows read, last role)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, last = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit
        moves = [(3, "I", i, t) for t in "ua"]
        if i < len(rows):
            role, fault = rows[i]
            more = 3 * (fault == "truncated")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last))
            if fault not in ("blank", "duplicate"):
                moves += [(more, "K", i + 1, role)] + [(3 + more, "R", i + 1, t) for t in "ua"]
        for more, letter, j, t in moves:
            if (last, t) in STEP:
                heapq.heappush(heap, (cost + more, audit + letter, j, STEP[last, t]))


def expected(rows):
    """The report's rows by brute force; ``rows`` of (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        held = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            way = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if way == 1:
                text = ""
            if way == 2:
                text = text.translate(str.maketrans("", "", ".!?"))
            if way == 4:
                role = "user"
            held += [(turn, role, text)] * (way != 0) + [(turn, role, text)] * (way == 3)
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, coded = set(), []
        for _, role, text in held:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            coded.append((role[:1], fault))
        cost, audit = cheapest(coded)
        lines, last, given = [], "", iter(held)
        for letter in audit:
            _, role, text = next(given) if letter != "I" else (None, "", "")
            if letter == "D":
                continue
            if letter != "K":
                role = next(r for r in ("user", "assistant") if (last, r[0]) in STEP)
            last = role[0]
            lines.append(f"{role}:{text}")
        turns = [t for t, _, _ in held if t is not None]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(coded, coded[1:]))
        faults = [f for _, f in coded]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines))))
    return out


CHAT = "conv_id long, turn long, role string, text string, part string, block string, cost string"


def chat_table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], CHAT)


def odd_chats(seed=7):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", " ", None, "why? ", "é.", "x.\n\t", "."]
    rows = [(c, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rnd.choice(texts))
            for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (70, None, "user", "No turn."),
             (71, 4, "assistant", "a" * 300_000 + "."), (72, 2, "system", "Alone.")]
    # rows repeated with their turn
    return rows + [r for r in rows[:40] for _ in range(rnd.randint(0, 1)) if rows.count(r) == 1 and r[2] is not None]


def test_repair_against_brute_force(spark):
    rows = odd_chats()
    # brute force keeps the given order within a turn; equal rows are the only ties here
    got = repair.repair_report(chat_table(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(rows)))
    assert repair.repair_report(chat_table(spark, [])).count() == 0
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert repair.repair_report(chat_table(spark, [])).columns == columns


def test_repair_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13_conversation_repair(spark, SF).collect())) == sorted(expected(rows))


def test_a_conversation_over_many_blocks_and_partitions(spark):
    """One conversation longer than a block, spread over range partitions, among small ones."""
    rnd = random.Random(9)
    rows = [(5, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["A.", "B.", "c", "", f"{t}."]))
            for t in range(1500)]
    rows += [(c, t, r, f"{t} {r}.") for c in (1, 9) for t, r in enumerate(["user", "assistant"] * 2)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    blocks = repair.repair_blocks(repair.faults(repair.damaged(chat_table(spark, rows).repartition(6))))
    of_long = blocks.where("conv_id = 5")
    assert of_long.select("part").distinct().count() > 1 and of_long.where("NOT opens").count() > 3
    got = repair.repair_report(chat_table(spark, rows).repartition(6)).collect()
    spark.conf.set(key, before)
    assert sorted(map(tuple, got)) == sorted(expected(rows))


def test_stacks_merge_and_other_grammars():
    r = repair.Repair()
    assert len(r.starts) == 10 and len(r.stacks.cells) == 16
    # two readings of one turn meet in one stack
    twice = repair.Repair({"chat": (("x",), ("y",)), "x": (("u",),), "y": (("u",),)}, "chat")
    front = twice.ways([("u", 0)], 0)
    assert min(cost + twice.ending(cell)[0] for cell, (cost, _) in front.items() if twice.ending(cell)) == 0
    with pytest.raises(ValueError):
        repair.Repair({"chat": (("u",), ("u", "chat"))}, "chat")
