"""Toxicity, packing, Jaccard join, token counts, suffix dedup, the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basketry.llm import common, jaccard_join, packing, suffix_dedup, tokens, toxicity
from basketry.llm.components import connected_components
from cases import SF, components, documents, empty, odd_texts, without_repeats

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_toxicity_finds_the_sentences(spark):
    rnd = random.Random(1)
    plain = [f"word{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(600):
        parts = [" ".join(rnd.choice(plain) for _ in range(8)) for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            parts[2] += " scoundrel knave"
        texts.append((i, ". ".join(parts) + "."))
        labels.append((i, int(toxic), "scoundrel"))
    docs = documents(spark, texts + odd_texts()[:5])
    known = spark.createDataFrame(labels + [(5, None, None), (None, 1, None)], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, known)
    rows = toxicity.score_texts(documents(spark, texts), model).join(
        known.where("toxic is not null").drop("text"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 80 and all((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    by_id = dict(texts)
    for r in rows:
        if r.toxic:
            assert any("scoundrel" in by_id[r.doc_id][s.start:s.end] for s in r.offending) and len(r.offending) == 1
    report = toxicity.toxicity_report(docs, known)
    assert report.count() == docs.count() and report.where("score is null or score < 0 or score > 1").count() == 0
    none = known.limit(0)
    assert toxicity.toxicity_report(docs, none).select("score").distinct().count() > 0
    assert toxicity.toxicity_report(empty(spark), known).count() == 0


def test_counts_and_ids_equal_the_library(library):
    rnd = random.Random(1)
    letters = list(" '\n\tstrevlmdaé 　1２.-!X́\u0085🙂") + ["<|endoftext|>", "'ll", "  "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += [t for _, t in odd_texts()]
    for row, data, offsets in common.chunks(pa.array(texts)):
        counts = tokens.token_counts(data, offsets, PATH)
        ids, bounds = tokens.token_ids(data, offsets, PATH)
        for i, n in enumerate(counts):
            want = library.encode(texts[row + i] or "", add_special_tokens=False).ids
            assert n == len(want) and ids[bounds[i]:bounds[i + 1]].tolist() == want, texts[row + i]


def test_prefix_counts_and_budgets(library, spark):
    rnd = random.Random(7)
    letters = list(" '\n\tstrevlmdaé 　1２.-!X")
    for _ in range(300):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))
        counts = tokens.PrefixCounts(text, PATH)
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert [counts.count(len(text[:k].encode())) for k in range(len(text) + 1)] == want
        for budget in (0, 1, 5, 100):
            assert counts.truncate(budget) >= 0 and counts.count(counts.truncate(budget)) <= budget
    assert tokens.model(PATH).encode(b" tokenization") == library.encode(" tokenization").ids
    docs = documents(spark, odd_texts())
    cut = tokens.truncate_texts(docs.where("doc_id != 30 or doc_id is null"), PATH, 10).collect()
    assert all(r.text is None or len(library.encode(r.text).ids) <= 10 for r in cut)
    got = tokens.token_report(docs, PATH, 512).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
            for i, t in odd_texts()]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(str, want))
    assert tokens.token_report(empty(spark), PATH, 512).count() == 0


def test_a_full_piece_table_starts_anew():
    table = tokens.PieceTable(lambda p: [len(p)], np.int32, log_slots=4)
    for word in range(200):
        raw = f"w{word} longer{word}".encode()
        data = np.frombuffer(raw, np.uint8)
        cut = raw.index(b" ")
        at, size = table(raw, common.prefix_hashes(data), np.array([0, cut]), np.array([cut, len(raw)]))
        assert table.flat[at].tolist() == [cut, len(raw) - cut] and size.tolist() == [1, 1]


def test_packing_round_trip(spark, library):
    texts = odd_texts()
    pieces = packing.pack_documents(documents(spark, texts), PATH).collect()
    sequences, whole = {}, {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u2")
        assert len(ids) == p.length and zlib.crc32(ids.astype("<u4").tobytes()) == p.ids_crc32
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        whole.setdefault(p.doc_id, []).append((p.start, ids.tolist(), p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.SEQUENCE
    total = sum(p.length for p in pieces)
    assert len(sequences) == -(-total // packing.SEQUENCE)
    for i, t in texts:
        want = library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        if [x for x, _ in texts].count(i) == 1:
            assert sum((ids for _, ids, _ in sorted(whole[i])), []) == want
            assert {n for _, _, n in whole[i]} == {len(want)}
    assert packing.packing_report(empty(spark), PATH).count() == 0


def test_packing_prefers_neighbours():
    rnd = np.random.default_rng(3)
    topics = [rnd.integers(t * 500, t * 500 + 400, (20, 512)) for t in range(4)]
    order = rnd.permutation(80)
    ids, bounds = np.concatenate([t for t in topics])[order].reshape(-1), np.arange(81) * 512
    holding = np.bincount(np.concatenate([np.unique(ids[a:a + 512]) for a in bounds[:-1]]), minlength=3000)
    pieces = packing.pack(ids, bounds, packing.Index(ids, bounds, holding, 80, 512.0))
    pure = sum(len({order[d] // 20 for d, _, _, s, _ in pieces if s == q}) == 1 for q in range(20))
    assert pure >= 16


def bm25(docs, seed):
    """Scores of all documents for the terms of one, straight from the formula."""
    mean = sum(map(len, docs)) / len(docs)
    out = []
    for d in docs:
        score = 0.0
        for t in {x for x in docs[seed] if x != packing.END_ID}:
            df, tf = sum(t in o for o in docs), d.count(t)
            score += (math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1)
                      / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)))
        out.append(score)
    return out


def test_index_scores_are_bm25():
    rnd = np.random.default_rng(8)
    docs = [[*rnd.zipf(1.4, rnd.integers(0, 60)).clip(2, 90).tolist(), packing.END_ID] for _ in range(50)]
    ids, bounds = np.concatenate(docs).astype(np.int64), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    holding = np.bincount(np.concatenate([np.unique(d) for d in docs]).astype(int), minlength=100)
    index = packing.Index(ids, bounds, holding, 50, len(ids) / 50)
    for seed in range(50):
        want = bm25(docs, seed)
        assert np.allclose(index.neighbours(seed), want)
        ranked = list(packing.best_first(index.neighbours(seed)))
        assert sorted(ranked) == [d for d in range(50) if want[d] > 1e-12]
        assert np.all(np.diff([want[d] for d in ranked]) <= 1e-9)
    doc, term, count = packing.term_counts(ids, bounds)
    weight = packing.term_weights(index.idf, doc, term, count, bounds, len(ids) / 50)
    for d, route in enumerate(packing.routes(doc, term, weight, 50).tolist()):
        own = sorted((-w, t) for w, t in zip(weight[doc == d].tolist(), term[doc == d].tolist()))[:packing.ROUTE_TERMS]
        want = [t for _, t in own] + [0xFFFF] * (packing.ROUTE_TERMS - len(own))
        assert [route >> 16 * k & 0xFFFF for k in reversed(range(packing.ROUTE_TERMS))] == want


def test_packing_brings_copies_together_across_shards(spark, monkeypatch):
    """Each text has a twin far away in the table; with shards of 8 documents a
    random deal would bring few together. A group of 60 copies is parted by row."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3_000)
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(3_000)]
    texts = [" ".join(rnd.choices(words, k=100)) for _ in range(60)]
    docs = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts)] + [(200 + i, "same " * 300) for i in range(60)]
    pieces = packing.pack_documents(documents(spark, docs), PATH).collect()
    shards, sizes = {}, Counter()
    for p in pieces:
        shards.setdefault(p.doc_id, set()).add(p.sequence_id >> 32)
        sizes[p.sequence_id >> 32] += p.length
    assert all(len(s) == 1 for s in shards.values()) and len(sizes) >= 8
    assert sum(shards[i] == shards[100 + i] for i in range(60)) >= 50
    assert len(set.union(*(shards[200 + i] for i in range(60)))) >= 2
    assert max(sizes.values()) < 3 * 3_000


def test_vocabularies_are_given_back_and_built_again():
    data = np.frombuffer("some words, two words".encode(), np.uint8)
    before = tokens.token_ids(data, np.array([0, len(data)]), PATH)[0].tolist()
    assert tokens._tables and tokens._models
    tokens.forget()
    assert not (tokens._tables or tokens._models or tokens._libraries)
    assert tokens.token_ids(data, np.array([0, len(data)]), PATH)[0].tolist() == before


def test_packing_routes_by_the_counts_of_all_documents(spark):
    """More documents than a sample of 4,000: each one's route follows the frequencies over all of them."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(400)]
    docs = [(i, " ".join(rnd.choices(words, k=4)) if i % 50 else None) for i in range(6_000)]
    texts, holding = packing.encoded_documents(documents(spark, docs), PATH)
    mean = texts.agg(F.avg("n_tokens")).first()[0]
    rows = packing.routed(texts, spark.sparkContext.broadcast(holding), len(docs), mean).orderBy("row").collect()
    ids = [np.frombuffer(bytes(r.ids), "<u2") for r in rows]
    flat, bounds = np.concatenate(ids), np.cumsum([0] + [len(x) for x in ids])
    doc, term, count = packing.term_counts(flat, bounds)
    held = np.bincount(term, minlength=len(holding)).astype(float)
    held[packing.END_ID] = len(docs)
    assert held.tolist() == holding.tolist() and mean == len(flat) / len(docs)
    weight = packing.term_weights(packing.rarity(held, len(docs)), doc, term, count, bounds, mean)
    assert [r.route for r in rows] == packing.routes(doc, term, weight, len(docs)).tolist()


def test_packing_loads_no_vocabulary_on_the_driver(spark):
    """Its tables would take 40 MB there for the rest of a session."""
    tokens.forget()
    pieces = packing.pack_documents(documents(spark, odd_texts()), PATH)
    assert pieces.count() and not (tokens._models or tokens._tables or tokens._libraries)


def test_packing_narrows_its_index_to_free_documents(monkeypatch):
    rnd = np.random.default_rng(5)
    docs = [[*rnd.zipf(1.4, rnd.integers(1, 200)).clip(2, 900).tolist(), packing.END_ID] for _ in range(300)]
    flat = np.array([t for d in docs for t in d], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    holding = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000).astype(float)

    def index():
        return packing.Index(flat, bounds, holding, 300, len(flat) / 300)
    whole, narrowed, free = index(), index(), np.ones(300, bool)
    for _ in range(4):
        free[rnd.integers(0, 300, 60)] = False
        narrowed.narrow(free)
        assert narrowed.left.tolist() == np.flatnonzero(free).tolist() and narrowed.rows.shape[1] == free.sum()
        for seed in range(0, 300, 7):
            assert narrowed.neighbours(seed).tolist() == whole.neighbours(seed)[free].tolist()
    monkeypatch.setattr(packing, "SEQUENCE", 256)
    used = index()
    packed = packing.pack(flat, bounds, used)
    assert len(used.left) < 300
    monkeypatch.setattr(packing, "NARROW", 0)
    assert packing.pack(flat, bounds, index()) == packed


def test_packing_closes_a_shard_at_its_bound(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_TOKENS", 5_000)
    docs = [(i, f"t{i % 7} " * (1 + 37 * i % 900)) for i in range(60)]
    pieces = packing.pack_documents(documents(spark, docs), PATH).collect()
    got, offsets = Counter(), {}
    for p in pieces:
        got[p.doc_id] += p.length
        offsets.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert {p.doc_id: p.doc_tokens for p in pieces} == dict(got) and len(got) == 60
    for parts in offsets.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= packing.SEQUENCE
    assert sum(sum(n for _, n in x) < packing.SEQUENCE for x in offsets.values()) > 1


def test_packing_fills_windows_of_short_texts_with_neighbours():
    """Forty texts a window, whose 34 heaviest terms are their own."""
    own = np.arange(400 * 34).reshape(400, 34) + 2000
    topic = np.arange(400) % 2
    ids = np.concatenate([own, topic[:, None] * 20 + np.arange(16) + 10, np.full((400, 1), packing.END_ID)], axis=1)
    bounds, flat = np.arange(401) * 51, ids.reshape(-1).astype(np.int64)
    holding = np.bincount(flat, minlength=16_000)
    index = packing.Index(flat, bounds, holding, 400, 51.0)
    assert (index.neighbours(0)[topic == 1] == 0).all() and (index.neighbours(0)[topic == 0] > 0).all()
    pieces = packing.pack(flat, bounds, index)
    assert sum(n for _, _, n, _, _ in pieces) == len(flat)
    kinds = [{topic[d] for d, _, _, s, _ in pieces if s == q} for q in range(-(-len(flat) // packing.SEQUENCE))]
    assert sum(len(k) > 1 for k in kinds) <= 1


def jaccard(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}


@pytest.mark.parametrize("part, home", [(20_000, 4096), (3, 2)])
def test_jaccard_components_against_brute_force(spark, monkeypatch, part, home):
    """With small parts every frequent shingle is dealt out to cells, and with
    small homes most lists are worked on alone."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "HOME", home)
    rnd = random.Random(8)
    texts = [(i, t) for i, t in dict(x for x in odd_texts() if x[0] is not None).items()]
    for group in range(6):
        base = [f"g{group}w{rnd.randint(0, 400)}" for _ in range(rnd.choice([12, 40, 150]))]
        for _ in range(12):
            near = list(base)
            for _ in range(rnd.randint(0, len(base) // 12)):
                near[rnd.randrange(len(near))] = f"c{rnd.randint(0, 50)}"
            texts.append((1000 + len(texts), " ".join(near)))
    shared = " ".join(f"s{k}" for k in range(60))
    texts += [(2000 + i, shared + " " + " ".join(f"u{rnd.randint(0, 10 ** 6)}" for _ in range(rnd.choice([5, 8, 200]))))
              for i in range(30)]
    assert jaccard(documents(spark, texts)) == components(texts)


def test_jaccard_copies_add_nothing_to_the_index(spark, monkeypatch):
    """However many copies there are, the index and the counts that deal shingles
    out to cells hold one of each set."""
    tables, stored = {}, common.stored

    def kept(df, name):
        tables[name] = stored(df, name)
        return tables[name]

    monkeypatch.setattr(common, "stored", kept)
    monkeypatch.setattr(jaccard_join, "PART", 3)
    base = [f"w{k}" for k in range(40)]
    texts = [(i, " ".join(base)) for i in range(60)] + [(60 + i, " ".join(base[:-1] + [f"x{i}"])) for i in range(2)]
    assert jaccard(documents(spark, texts).repartition(5)) == components(texts)
    prefixes = tables["jaccard_prefixes"]
    assert prefixes.where("part is null").count() == prefixes.select("set").distinct().where("set is not null").count() == 3
    counts = jaccard_join._bucket_counts(prefixes)
    assert counts.sum() == 3 * 8 and counts.max() <= 3 and (jaccard_join.Parts(counts)(
        np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)) == 1).all()


def test_jaccard_deals_out_the_sets_of_a_hot_pivot(spark, monkeypatch):
    """No list that is worked on at a time holds all near copies of a group."""
    worked, stored = [], common.stored

    def kept(df, name):
        if name == "star_links":
            worked.append(rows.pop())
        return stored(df, name)

    rows, links_of = [], jaccard_join._links_of

    def seen(docs, members, chosen, shared, name):
        members = stored(members, "seen")
        if name == "star":
            rows.append(members)
        return links_of(docs, members, chosen, shared, name)

    monkeypatch.setattr(common, "stored", kept)
    monkeypatch.setattr(jaccard_join, "_links_of", seen)
    monkeypatch.setattr(jaccard_join, "HOME", 16)
    base = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(120)] + [(500, "a b c d e f"), (501, "a b c d e f")]
    assert jaccard(documents(spark, texts)) == components(texts)
    stars = worked[0]
    sizes = [r["count"] for r in stars.groupBy("list").count().collect()]
    assert sum(sizes) > 120 and max(sizes) <= 24
    lists = {r["list"] for r in stars.where("probe").select("list").collect()}
    assert lists == {r["list"] for r in stars.select("list").collect()}


def test_components_keep_no_hash_tables_on_the_driver(spark, monkeypatch):
    plans, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: (
        plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df, name))[1])
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 8], "a long, b long")
    assert {r.node: r.root for r in connected_components(links, merge=True).collect()} == {i: max(1, (i - 1) // 8 * 8 + 1)
                                                                              for i in range(1, 41)}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_jaccard_looks_once_where_all_lists_are_connected(spark, monkeypatch):
    names, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: (names.append(name), stored(df, name))[1])
    rnd = random.Random(6)
    texts = [" ".join(f"w{rnd.randrange(10_000)}" for _ in range(60)) for _ in range(20)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts)]
    out = jaccard_join.jaccard_components(documents(spark, docs)).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: i % 100 for i, _ in docs}
    assert names.count("star_links") == 1 and "list_sets" not in names and names.count("links") == 1


def test_jaccard_of_repeats_nulls_and_empty(spark):
    rows = jaccard_join.jaccard_components(documents(spark, odd_texts()))
    assert rows.count() == len(odd_texts())
    assert rows.where("doc_id is null and component_id is not null").count() == 0
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def test_trie_links_equal_all_pairs():
    rnd = np.random.default_rng(1)
    order = jaccard_join.GlobalOrder(rnd.integers(0, 9, 1 << jaccard_join.COUNT_BITS))
    base = rnd.integers(0, 1 << 63, 40).astype(np.uint64)
    sets = []
    for _ in range(60):
        keep = base[rnd.random(40) > 0.12]
        sets.append(np.unique(np.concatenate([keep, rnd.integers(0, 1 << 63, rnd.integers(0, 4)).astype(np.uint64)])))
    sets.append(np.unique(base[:3]))
    names = list(range(len(sets)))
    found = jaccard_join.Links(np.array(names), np.array(names))
    jaccard_join.list_links(names, sets, [True] * len(sets), order, found)
    links = found.found

    def similar(a, b):
        n = len(np.intersect1d(a, b))
        return 100 * n >= 80 * (len(a) + len(b) - n)

    def groups(pairs):
        parent = list(range(len(sets)))
        for a, b in pairs:
            ra, rb = parent[a], parent[b]
            parent = [ra if p == rb else p for p in parent]
        return {frozenset(i for i, p in enumerate(parent) if p == q) for q in parent}

    assert all(similar(sets[a], sets[b]) for a, b in links)
    assert groups(links) == groups([(a, b) for a in names for b in names if a < b and similar(sets[a], sets[b])])


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    got = dict(map(tuple, connected_components(links).collect()))
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99}


def repeats(docs):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
                  for r in suffix_dedup.remove_repeats(docs).collect())


@pytest.mark.parametrize("folded, sorted_, hot, wide", [(400_000, 16_000, 32_000, 16_000), (40, 25, 0, 16_000),
                                                        (400_000, 16_000, 3, 4), (400_000, 16_000, 0, 1)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, folded, sorted_, hot, wide):
    """Whichever grams are dealt out by surroundings or leave the sort for single strings."""
    for name, value in zip(("FOLDED", "SORTED", "HOT", "WIDE"), (folded, sorted_, hot, wide)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh é") for _ in range(700))
    texts = []
    for i in range(120):
        a, b = sorted(rnd.randrange(700) for _ in range(2))
        own = "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(0, 150)))
        texts.append((i, rnd.choice([own + passage[a:b] + own, passage[a:a + 100], passage[a:a + 99] + own, "ab" * 120,
                                     own + "z" * rnd.randint(90, 240), passage[a:b] + passage[a:b]])))
    texts += [(500, None), (501, ""), (502, passage), (503, passage)]
    want = [str((i, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            for (i, _), (n, kept, runs) in zip(texts, without_repeats([t for _, t in texts]))]
    rnd.shuffle(texts)
    assert repeats(documents(spark, texts).repartition(3)) == sorted(want)


def test_suffix_dedup_of_odd_rows(spark):
    rows = suffix_dedup.remove_repeats(documents(spark, odd_texts())).collect()
    assert len(rows) == len(odd_texts()) and all(r.n_removed <= r.n_bytes for r in rows)
    # rows equal in id and text get one result
    assert len({str(r) for r in rows if r.doc_id == 7}) == 1
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_keeps_one_copy_of_repeated_rows(spark, monkeypatch):
    """Rows repeated with id and text, and no earlier copy, are one document."""
    rnd = random.Random(4)
    text, other, shared = ("".join(rnd.choice("abcdefgh ") for _ in range(n)) for n in (400, 300, 150))
    twice = [(1, text), (2, other + shared + other), (None, shared * 2)]
    once = [(3, text[50:250]), (4, shared + text)]
    order = [twice[2], *twice[:2], *once]
    want = {i: (n - len(kept), hashlib.sha256(kept).hexdigest())
            for (i, _), (n, kept, _) in zip(order, without_repeats([t for _, t in order]))}
    rows = suffix_dedup.remove_repeats(documents(spark, twice * 2 + once + twice).repartition(3)).collect()
    assert len(rows) == 11 and all((r.n_removed, r.kept_sha256) == want[r.doc_id] for r in rows)
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    monkeypatch.setattr(suffix_dedup, "WIDE", 1)
    again = suffix_dedup.remove_repeats(documents(spark, twice * 2 + once + twice).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert want[1][0] == 0


def test_merge_sort_of_suffixes_and_a_misleading_hash(monkeypatch):
    rnd = random.Random(3)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 6))) for _ in range(300)]
    group = np.sort(np.random.default_rng(1).integers(0, 20, 300))
    data, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings])
    start = np.cumsum(size) - size
    want = sorted(range(300), key=lambda i: (group[i], strings[i]))
    order, shared = suffix_dedup._verified_order(data, start, size, group, 6)
    assert [strings[i] for i in order] == [strings[i] for i in want]
    monkeypatch.setattr(suffix_dedup, "_common", lambda prefix, a, b, limit: limit)
    again, true = suffix_dedup._verified_order(data, start, size, group, 6)
    assert [strings[i] for i in again] == [strings[i] for i in want] and (true == shared).all()


def test_pipeline_stages(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = given, {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == given.columns
            docs = out
            kept[name] = {r.doc_id: r.text for r in out.collect()}
        else:
            assert {r[0] for r in out.select("doc_id").distinct().collect()} == set(kept["secrets"])
    good = [(i, t) for i, t in kept["quality"].items()]
    groups = components(good)
    assert set(kept["near_duplicates"]) == {c for _, c in groups.values()}
    assert set(kept["decontamination"]) == set(kept["secrets"]) < set(kept["near_duplicates"])
    assert not any("token = \"" in t for t in kept["secrets"].values())


def test_pipeline_keeps_odd_rows_apart(spark):
    docs = documents(spark, odd_texts())
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert out.columns == docs.columns
    left = out.collect()
    assert sum(r.doc_id == 7 for r in left) == 0 and sum(r.doc_id == 6 for r in left) == 1
    assert sum(r.doc_id is None and r.text is not None for r in left) == 1
    assert corpus_pipeline.near_duplicate_stage(spark, empty(spark), SF).count() == 0
    assert corpus_pipeline.decontamination_stage(spark, docs, SF).count() == docs.count()
    assert corpus_pipeline.quality_stage(spark, empty(spark).drop("rejected_by"), SF).count() == 0
