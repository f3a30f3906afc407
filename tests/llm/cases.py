"""Small tables and brute-force answers for the training-data operators."""

import random
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"

# columns whose names the operators use themselves
SCHEMA = ("doc_id long, text string, words string, row long, kind string, `set` string, part int, id string, "
          "tie string, spans string, shard int, ids string, n_tokens string, rejected_by string, key string, "
          "hash string, score string, items string, n_chars long")


def documents(spark, texts):
    """A table of (doc_id, text) with clashing extra columns, all null in every
    second row."""
    width = SCHEMA.count(",") + 1
    rows = [(i, t, *([None] * (width - 3) if k % 2 else ["x", 7, "y", "z", 3, "i", "t", "s", 2, "a", "b", "c", "d",
                                                         "e", "f", "g"]),
             None if t is None or k % 2 else len(t)) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_texts(seed=5):
    """Nulls, empties, repeats, ties, a very long text, copies and near copies."""
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Été", "straße", "naïve", "data", "x1", "日本", "end.", "a", "b,", "C", "moron!"]
    base = [rnd.choice(vocabulary) + str(rnd.randint(0, 60)) for _ in range(90)]
    out = [(0, None), (1, ""), (2, "   \n\t "), (3, "word"), (4, "two words"), (5, "five small words in row"),
           (6, " ".join(base)), (7, " ".join(base)), (7, " ".join(base)), (None, "an unnamed text of some words"),
           (None, None), (8, " ".join(rnd.choice(base) for _ in range(40_000))), (9, "aaaa " * 300), (9, "other text")]
    for i in range(10, 24):
        near = list(base)
        for _ in range(rnd.randint(1, 4)):
            near[rnd.randrange(len(near))] = "changed" + str(rnd.randint(0, 9))
        out.append((i, " ".join(near)))
    return out + [(30, "<|endoftext|> inside"), (31, "tail  "), (32, "x" * 250), (33, "x" * 99), (34, "word")]


WORD = {"space": re.compile(rb"[^\x20\x09-\x0D]+"), "alnum": re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def words(text, kind):
    return WORD[kind].findall((text or "").encode().lower())


def components(texts):
    """id -> (n_shingles, component) of texts with distinct ids, by all pairs of
    sets that share a shingle."""
    sets = {}
    for i, t in texts:
        w = words(t, "space")
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset(
            [tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def without_repeats(texts, length=100):
    """(n_bytes, kept bytes, runs) per text, in the order given."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            part = raw[k:k + length]
            if part in seen:
                covered[k:k + length] = b"\1" * length
            else:
                seen.add(part)
        runs = sum(1 for k in range(len(raw)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((len(raw), bytes(b for b, c in zip(raw, covered) if not c), runs))
    return out
