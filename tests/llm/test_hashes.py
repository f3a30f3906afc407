"""Texts on which polynomial hashes modulo 2^64 collide, hashes that collide by
force, and texts that make an expression read again and again."""

import time

import numpy as np
from tokenizers import Tokenizer

from basketry.llm import common as C
from basketry.llm import decontaminate, jaccard_join, packing, secrets, suffix_dedup, tokens
from basketry.llm.queries import VOCABULARY
from cases import components, documents, without_repeats


def twins(letters="in", doublings=11):
    """A Thue-Morse word over two letters, and the same with the letters exchanged."""
    a, b = letters
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_long_words_have_hashes_of_their_own():
    data, offsets = chunk(twins())
    prefix = C.prefix_hashes(data)
    same = C.range_hashes(prefix, offsets[:-1], offsets[1:])
    assert same[0] == same[1]
    starts, ends, _ = C.word_bounds(data, offsets, C.NOT_SPACE)
    assert len(set(C.word_hashes(data, starts, ends).tolist())) == 2


def test_counts_and_ids_of_colliding_pieces(spark):
    texts = [*twins(), "x " + twins()[1], twins()[0]]
    library = Tokenizer.from_file(VOCABULARY)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    data, offsets = chunk(texts)
    assert tokens.token_counts(data, offsets, VOCABULARY).tolist() == [len(w) for w in want]
    ids, bounds = tokens.token_ids(data, offsets, VOCABULARY)
    assert [p.tolist() for p in np.split(ids, bounds[1:-1])] == want
    got = packing.packing_report(documents(spark, list(enumerate(texts))), VOCABULARY).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(w) + 1 for i, w in enumerate(want)}


def test_a_table_whose_hashes_all_collide(monkeypatch):
    monkeypatch.setattr(C, "mix", lambda h: h & np.uint64(2))
    table = tokens.PieceTable(lambda piece: [len(piece), *piece], np.int32)
    words = [b"a", b"bc", b"a", b"de", b"bc", b"f"]
    raw = b"".join(words)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for _ in range(2):
        at, size = table(raw, C.prefix_hashes(np.frombuffer(raw, np.uint8)), starts, ends)
        assert [table.flat[a:a + n].tolist() for a, n in zip(at, size)] == [[len(w), *w] for w in words]


def test_pieces_that_differ_in_any_byte_are_told_apart():
    """All in one slot; words of 8 bytes are compared, the last one in part."""
    for n in (0, 1, 7, 8, 9, 15, 16, 17, 40):
        kept = bytes(range(65, 65 + n))
        table = tokens.PieceTable(lambda piece: [len(piece)], np.int32)
        table._add(np.array([1], np.uint64), [kept], [[n]])
        given = [kept, kept + b"x", *[kept[:i] + b"~" + kept[i + 1:] for i in range(n)]]
        ends = np.cumsum([len(g) for g in given])
        starts = np.concatenate([[0], ends[:-1]])
        slot = np.repeat(table._probe(np.array([1], np.uint64)), len(given))
        assert table._others(b"".join(given), starts, ends, slot).tolist() == list(range(1, len(given)))


def test_operators_on_colliding_texts(spark):
    a, b = twins()
    texts = [(1, a), (2, b), (3, " ".join([a, "one two three four"])), (4, " ".join([b, "one two three four"])), (5, a)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, texts)).collect()}
    assert got == components(texts) and got[1][1] != got[2][1] and got[3][1] != got[4][1]
    item = spark.createDataFrame([(7, f"{a} x y z")], "item_id long, text string")
    hits = decontaminate.contamination_report(documents(spark, [(1, f"{b} x y z"), (2, f"{a} x y z")]), item).collect()
    assert {r.doc_id: r.n_hit for r in hits} == {1: 0, 2: 4}
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert cut == {i: (n, n - len(kept), runs) for (i, _), (n, kept, runs) in zip(texts, without_repeats([t for _, t in texts]))}


def test_secrets_of_a_megabyte_of_keywords(spark):
    texts = [(1, "eyJ" * 350_000), (2, "eyJhbGciOiJIUzI1NiJ9." * 40_000), (3, "eyJ" * 1000 + ".eyJhbGciOiJIUzI1NiJ9.e30.x"),
             (4, "ghp_" * 250_000), (5, "-----BEGIN PRIVATE KEY-----" * 40_000), (6, "token " * 150_000)]
    began = time.time()
    got = {r.doc_id: r.spans for r in secrets.secrets_report(documents(spark, texts)).collect()}
    assert time.time() - began < 60
    assert "jwt:" in got[2] and "jwt" not in got[1]
