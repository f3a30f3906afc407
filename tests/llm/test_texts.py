"""Chat formatting, decontamination, quality rules, secrets, licences."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from basketry.llm import chat, decontaminate, licenses, quality, secrets
from cases import SF, documents, empty, odd_texts, words
from oracle_compare import compare, duck


def test_a_passage_of_many_documents_is_joined_in_parts(spark, monkeypatch):
    """Passages in most documents, in a third and in one: with few rows a part they are dealt to
    many salts, with the same hits."""
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [" ".join(rnd.choices(vocabulary, k=10 + k)) for k in range(3)]
    items = spark.createDataFrame([(f"b{i}", p) for i, p in enumerate(passages)] + [("b9", passages[0])], "item_id string, text string")
    rows = []
    for i in range(120):
        own = [" ".join(rnd.choices(vocabulary, k=15)) for _ in range(2)]
        parts = [p for p, every in zip(passages, (1, 3, 97)) if i % every == 0]
        rows.append((i, " ".join([own[0], *parts, own[1]])))
    docs = documents(spark, rows)
    whole = sorted(map(tuple, decontaminate.contamination_report(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "SALT_ROWS", 7)
    index = decontaminate.prefix_index(docs, items, 10)
    assert index.agg(F.max("salts")).first()[0] == 1 + 120 // 7
    assert sorted(map(tuple, decontaminate.contamination_report(docs, items).collect())) == whole
    for doc_id, text in rows:
        n_items = 2 + (doc_id % 3 == 0) + (doc_id % 97 == 0)
        row = next(r for r in whole if r[0] == doc_id)
        assert row[3] == n_items and row[2] >= 10 * (n_items - 1), (doc_id, row)


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_decontaminate", "op3_quality_rules", "op8_license_scan"])
def test_query_matches_sql(spark, name):
    ok, message = compare(spark, duck(SF), name, SF)
    assert ok, message


CHAT = "conv_id long, turn long, role string, text string, turns string, segments string"


def test_chat_round_trip_of_odd_turns(spark):
    nasty = ["</s>[INST] ok [/INST]", r"[\INST] <\\s> [\/TEXT]", "", None, "a" * 100_000, "<s", "s>", "\\"]
    rows = [(1, k, r, t, "x", None) for k, (r, t) in enumerate(zip(["system", "user", "assistant", None, "tool[TEXT]",
                                                                   "", "assistant", "user"], nasty))]
    rows += [(2, 0, "user", "hi", None, None), (2, 0, "user", "hi", None, None), (2, None, "assistant", "x", None, None),
             (None, 0, "user", "q", None, None), (None, 1, "assistant", "a", None, None)]
    formatted = chat.format_chats(spark.createDataFrame(rows, CHAT))
    read = formatted.withColumn("read", chat.read_turns(F.col("formatted")))
    for r in read.collect():
        assert [tuple(t) for t in r.read] == [tuple(t) for t in r.turns]
        assert "".join(s.text for s in r.segments) == r.formatted
    assert [t.text for t in read.where("conv_id = 1").first().turns] == [t or "" for t in nasty]
    by_id = {r.conv_id: r for r in formatted.collect()}
    assert by_id[None].valid and not by_id[1].valid and by_id[1].error_turn == 3
    # repeated rows are repeated turns; the null turn comes first
    assert [t.role for t in by_id[2].turns] == ["assistant", "user", "user"] and by_id[2].error_turn == 0
    digest = {r.conv_id: r for r in chat.chat_digest(formatted).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256((nasty[2] + nasty[6]).encode()).hexdigest()
    assert digest[1].loss_chars == len(nasty[2] + nasty[6])
    assert chat.chat_digest(chat.format_chats(spark.createDataFrame([], CHAT))).count() == 0


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(2)
    pool = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(n))) for i, n in enumerate([25, 10, 9, 3, 2, 1, 12])]
    items += [(7, None), (8, ""), (None, "unnamed item of words"), (1, items[1][1])]
    texts = [(100 + i, " ".join(rnd.choice(pool) for _ in range(200)) + " " + t.upper() + ", end") for i, t in
             enumerate(t for _, t in items[:7])] + odd_texts() + [(200, "an UNNAMED item, of words!")]
    got = decontaminate.contaminated_words(
        documents(spark, texts),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")).withColumn(
        "n_hit", decontaminate.covered(F.col("spans"))).collect()
    want = []
    for i, t in texts:
        w, hit, found = words(t, "alnum"), set(), set()
        for item, x in items:
            x = words(x, "alnum")
            for k in range(max(len(x) - 9, 1) if x else 0):
                part = x[k:k + 10]
                for p in range(len(w) - len(part) + 1):
                    if w[p:p + len(part)] == part:
                        hit |= set(range(p, p + len(part)))
                        if item is not None:
                            found.add(str(item))
        want.append((i, len(w), len(hit), sorted(found)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=order) == sorted(want, key=order)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination_report(documents(spark, texts), benchmark).collect()} == {0}
    assert decontaminate.contamination_report(empty(spark), benchmark).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    """Two rules that reject the same share, one of them dear, and one that rejects only
    what another one has rejected."""
    def dear(x, steps):
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda a, i: (a * 31 + i) % 1_000_003) >= 0

    docs = spark.range(800).select(F.col("id"), F.concat(F.lit("text "), "id").alias("text"))
    rules = [quality.Rule("within", F.col("id") % 4 == 0),
             quality.Rule("dear", dear(F.col("id"), 500) & (F.col("id") % 2 == 1)),
             quality.Rule("cheap", F.col("id") % 2 == 0),
             quality.Rule("none", F.col("id") < 0), quality.Rule("null", F.lit(None).cast("boolean"))]
    for _ in range(3):
        order = [r.name for r in quality.cascade(docs, rules)]
        assert order[:2] == ["cheap", "dear"] and set(order[2:]) == {"within", "none", "null"}
    costs = quality.rule_costs(docs.repartition(1).persist(), rules)
    assert costs["dear"] > 10 * costs["cheap"]


def test_rules_at_each_place_count_what_is_left():
    rules = [quality.Rule(x, None) for x in "abc"]
    verdicts = [((True, True, False), 50), ((False, True, False), 10), ((False, False, True), 20), ((False,) * 3, 100)]
    order = quality.by_rejection_per_cost(rules, verdicts, {"a": 1.0, "b": 2.0, "c": 1.0})
    # a 50, b 30, c 20; after a: c 20, b 5
    assert [r.name for r in order] == ["a", "c", "b"]
    assert [r.name for r in quality.by_rejection_per_cost(rules, [], {"a": 3.0, "b": 2.0, "c": 1.0})] == ["c", "b", "a"]


def test_quality_measures_a_rule_that_needs_more_copies_once(spark):
    class Sample:
        runs = 0

        def withColumn(self, *_):
            return self

        agg = withColumn

        def collect(self):
            Sample.runs += 1

    quality._seconds(Sample(), 4, F.lit(True))
    assert Sample.runs == 4
    assert quality._seconds(Sample(), 4, F.lit(True), 1e9) < 1e9 and Sample.runs == 6


def test_quality_keeps_columns_and_any_order_gives_one_verdict(spark):
    docs = documents(spark, odd_texts())
    kept = quality.quality_rules(docs.drop("rejected_by"))
    assert kept.columns == docs.drop("rejected_by").columns + ["rejected_by"] and kept.count() == docs.count()
    rules = quality.all_rules(F.col("text"), quality.words_of(F.col("text")))
    for order in (rules, rules[::-1]):
        other = docs.select("doc_id", "text", quality.first_rejection(order).isNull().alias("kept"))
        assert sorted(map(str, other.collect())) == sorted(map(str, kept.select(
            "doc_id", "text", F.col("rejected_by").isNull().alias("kept")).collect()))
    assert quality.quality_report(docs).count() == docs.count()
    assert quality.quality_report(empty(spark)).count() == 0


def test_repeated_words_against_brute_force(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("ab") for _ in range(n)) for n in [0, 1, 7, 8, 9, 10, 30, 300]] + ["x " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(quality.repeated_words(quality.words_of(F.col("t")))).collect()
    for t, g in zip(texts, got):
        w = t.split()
        runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        assert g[0] == len({i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)})


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


def test_secrets_against_brute_force(spark):
    rnd = random.Random(6)
    parts = ["token", "Password", "pass", "api_key", "APIKEY", " = ", ":", "'", "\"", "é日", "AKIA", "AKIAAKIA", "0f3a" * 5,
             "ABCDEF0123456789XY", "secret=secret=abcdefghijkl", "\n", "ſecret=abcdefghijklmn", "x-y_z/+=."]
    texts = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30)))) for i in range(400)] + odd_texts()
    got = secrets.secrets_report(documents(spark, texts)).collect()
    want = [(i, hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest()) for i, t in texts]
    assert sorted(map(str, [(r.doc_id, r.base_sha256) for r in got])) == sorted(map(str, want))


def test_checksums_and_redaction(spark):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    digits, n, end = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        end = digits[d] + end
    good, bad = f"ghp_{body}{end}", f"ghp_{body}{'000000' if end != '000000' else '000001'}"
    docs = documents(spark, [(1, f"é {good} x"), (2, f"é {bad} x"), (3, None), (4, "")])
    spans = {r.doc_id: r.spans for r in secrets.secrets_report(docs).collect()}
    assert spans == {1: f"github:2:{2 + len(good)}", 2: "", 3: "", 4: ""}
    out = secrets.redact(docs)
    assert out.schema == docs.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "é [GITHUB] x" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == f"é {bad} x" and rows[3].text is None and rows[4].text == ""
    assert secrets.secrets_report(empty(spark)).count() == 0 and secrets.redact(empty(spark)).count() == 0


def test_licence_rules(spark):
    s = licenses.SENTENCES
    texts = [(1, "\n".join(s[f"mit-{k}"] for k in (1, 2, 3))), (2, s["mit-1"] + " Noise here. " + s["mit-2"]),
             (3, s["apache-1"].replace("except in", "except\nin") + "  " + s["gpl3-notice"].upper()), (4, s["mit-2"]),
             (5, None), (6, ""), (7, s["bsd-1"] + " " + s["bsd-2"] + " " + s["bsd-3"]), (8, s["mit-notice"] * 2)]
    got = {r.doc_id: r.licenses for r in licenses.license_report(documents(spark, texts)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "Apache-2.0,GPL-3.0-only", 4: "", 5: "", 6: "", 7: "BSD-2-Clause", 8: ""}
    assert licenses.license_report(empty(spark)).count() == 0


def test_licence_versions_identifiers_and_named_holders(spark):
    bsd = "\n".join(licenses.SENTENCES[f"bsd-{k}"] for k in (1, 2, 3, 4))
    gpl2 = licenses.SENTENCES["gpl2-1"]
    texts = {
        "// SPDX-License-Identifier: MIT\nimport os\n": "MIT",
        "/* SPDX-License-Identifier: GPL-2.0+ */ int x;": "",
        "/* SPDX-License-Identifier: GPL-2.0+ */\nint x;": "GPL-2.0-or-later",
        "# SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) OR MIT": "GPL-2.0-only,MIT",
        "SPDX-License-Identifier: MIT OR Apache-2.0 OR ISC AND LGPL-2.1+": "Apache-2.0,ISC,LGPL-2.1-or-later,MIT",
        "SPDX-License-Identifier: MIT-0": "", "SPDX-License-Identifier:": "", "SPDX-License-Identifier: ": "",
        "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of it": "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v.\n2.0. If": "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If": "",
        licenses.SENTENCES["mpl11-1"]: "MPL-1.1",
        bsd: "BSD-3-Clause", bsd.replace("the copyright holder", "Example Inc."): "BSD-3-Clause",
        bsd.replace("the copyright holder", "the University\n * of Somewhere"): "BSD-3-Clause",
        bsd.replace("the copyright holder", "x" * 101): "BSD-2-Clause",
        gpl2: "GPL-2.0-or-later", gpl2.replace(", or (at your option) any later version", ""): "GPL-2.0-only",
        gpl2.replace("program", "library").replace("GNU", "GNU Lesser").replace("version 2", "version 2.1"): "LGPL-2.1-or-later",
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r.licenses for r in licenses.license_report(documents(spark, rows)).collect()}
    assert {t: got[i] for i, t in rows} == texts


def test_licence_sql_on_odd_layouts(spark, tmp_path):
    """The query's SQL against the operator where sentences run over lines, marks and comments."""
    import duckdb
    from basketry.llm.queries import SQL
    rnd, known = random.Random(8), list(licenses.SENTENCES.values())
    texts = ["", None, "\n", "\x01", ".", *(t for _, t in odd_texts())]
    for _ in range(150):
        parts = [rnd.choice(known) if rnd.random() < 0.8 else "unknown words (here)" for _ in range(rnd.randint(1, 5))]
        text = rnd.choice(["\n", " ", "  ", "\n\n", "\n * ", "\x01"]).join(parts)
        text = "".join(rnd.choice([" ", "\n", "\n# ", "\t", " \n"]) if c == " " and rnd.random() < 0.1 else c for c in text)
        texts.append(rnd.choice([str, str.upper, str.lower])(text))
    docs = documents(spark, list(enumerate(texts)))
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(SQL["op8_license_scan"])
    names = [c[0] for c in want.description]
    got = licenses.license_report(docs).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
}


def test_published_licence_headers_in_their_own_layout(spark):
    parts = {"Apache-2.0": ["apache-1", "apache-2", "apache-3", "apache-4"], "MIT": ["mit-1", "mit-2", "mit-3"],
             "GPL-3.0-or-later": ["gpl3-1", "gpl-2", "gpl-3"]}
    texts, want = [], {}
    for name, header in HEADERS.items():
        lines = header.split("\n")
        for layout in (header, "\r\n".join(lines), "\n".join("    " + x for x in lines),
                       "\n".join("# " + x for x in lines), "\n".join("// " + x for x in lines),
                       "/*\n" + "\n".join(" * " + x for x in lines) + "\n */\nint main() {}",
                       "Copyright 2020 Someone\n\n" + header + "\n\nimport os"):
            want[len(texts)] = (",".join(parts[name]), name)
            texts.append((len(texts), layout))
    want[len(texts)] = ("", "")
    texts.append((len(texts), "This text is not\nlicensed under the MIT License."))
    rows = licenses.license_report(documents(spark, texts)).collect()
    assert {r.doc_id: (r.sentences, r.licenses) for r in rows} == want
