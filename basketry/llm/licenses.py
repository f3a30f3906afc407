r"""License scans by sentence rules: sentences of a text are normalised and mapped
to identifiers of known licence sentences, and the sequence of identifiers is
matched against ordered rules, longest first; a sentence that one rule has used
is not used again. DataFrame functions only.

A line that does not end a sentence continues in a next line that starts with a
small letter, a bracket or a quote; sentences end at line ends, at . ! ? before
white space, and at a colon before white space and a capital. A known sentence may
also run over several lines, whatever their breaks, indentation, blank lines and
comment marks (# * // and the like), but starts and ends where a sentence does; the
longest known sentence counts. The name that a clause "Neither the name of .. nor the names of" gives (up to 100
characters) counts as the copyright holder. An SPDX-License-Identifier names every licence of its expression that is known,
joined by OR or AND, whatever its exceptions. Normal form: A-Z in lower case, every run of other characters than
a-z0-9 one blank, no blank at the ends. Defined results: a null or empty text has
no sentences and no licence; unknown sentences stand between known ones without
parting them; a licence found several times is listed once; repeated rows give a
row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licences and licence notices.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-1": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                'compliance with the License.',
    "apache-2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-3": 'Unless required by applicable law or agreed to in writing, software distributed under the License is '
                'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
                'implied.',
    "apache-4": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
             'associated documentation files (the "Software"), to deal in the Software without restriction, including '
             'without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell '
             'copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the '
             'following conditions:',
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial "
             "portions of the Software.",
    "mit-3": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
             'LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
              "General Public License as published by the Free Software Foundation, either version 3 of the License, "
              "or (at your option) any later version.",
    "gpl2-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
              "General Public License as published by the Free Software Foundation; either version 2 of the License, "
              "or (at your option) any later version.",
    "gpl-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
             "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-3": "See the GNU General Public License for more details.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
             "that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
             "following disclaimer.",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
             "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted, provided that the above copyright notice and this permission notice appear in all "
             "copies.",
    "mpl2-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl11-1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may '
               'not use this file except in compliance with the License.',
    "gpl2-only-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-only-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation; either version 2 of the "
                   "License.",
    "gpl2-only-3": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl3-only-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                   "General Public License as published by the Free Software Foundation, version 3 of the License.",
    "lgpl21-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                "License, or (at your option) any later version.",
    "lgpl3-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
               "Lesser General Public License as published by the Free Software Foundation; either version 3 of the "
               "License, or (at your option) any later version.",
    "lgpl-2": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
              "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-3": "See the GNU Lesser General Public License for more details.",
    "agpl3-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
               "License, or (at your option) any later version.",
    "agpl-3": "See the GNU Affero General Public License for more details.",
}

# Identifiers of SPDX lines, with the current name of the older ones.
SPDX = {x: x for x in (
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-1.1", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")}
SPDX |= {x: f"{x}-only" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
SENTENCES |= {f"spdx-{x.lower()}": f"SPDX-License-Identifier {x}" for x in SPDX}

#: (licence, sentences in order); the first rule that fits takes its sentences.
RULES = [
    ("Apache-2.0", ["apache-1", "apache-2", "apache-3", "apache-4"]),
    ("BSD-3-Clause", ["bsd-1", "bsd-2", "bsd-3", "bsd-4"]),
    ("BSD-2-Clause", ["bsd-1", "bsd-2", "bsd-3"]),
    ("MIT", ["mit-1", "mit-2", "mit-3"]),
    ("GPL-3.0-or-later", ["gpl3-1", "gpl-2", "gpl-3"]),
    ("GPL-2.0-or-later", ["gpl2-1", "gpl-2", "gpl-3"]),
    ("GPL-2.0-only", ["gpl2-only-1", "gpl-2", "gpl-3"]),
    ("GPL-2.0-only", ["gpl2-only-2", "gpl-2", "gpl-3"]),
    ("GPL-2.0-only", ["gpl2-only-3", "gpl-2", "gpl-3"]),
    ("GPL-3.0-only", ["gpl3-only-1", "gpl-2", "gpl-3"]),
    ("LGPL-2.1-or-later", ["lgpl21-1", "lgpl-2", "lgpl-3"]),
    ("LGPL-3.0-or-later", ["lgpl3-1", "lgpl-2", "lgpl-3"]),
    ("AGPL-3.0-or-later", ["agpl3-1", "gpl-2", "agpl-3"]),
    ("MIT", ["mit-1", "mit-2"]),
    ("Apache-2.0", ["apache-1"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("GPL-3.0-or-later", ["gpl3-1"]),
    ("GPL-2.0-or-later", ["gpl2-1"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("ISC", ["isc-1"]),
    ("MPL-2.0", ["mpl2-1"]),
    ("MPL-1.1", ["mpl11-1"]),
    ("GPL-2.0-only", ["gpl2-only-1"]),
    ("GPL-2.0-only", ["gpl2-only-2"]),
    ("GPL-2.0-only", ["gpl2-only-3"]),
    ("GPL-3.0-only", ["gpl3-only-1"]),
    ("LGPL-2.1-or-later", ["lgpl21-1"]),
    ("LGPL-3.0-or-later", ["lgpl3-1"]),
    ("AGPL-3.0-or-later", ["agpl3-1"]),
] + [(name, [f"spdx-{x.lower()}"]) for x, name in SPDX.items()]

CONTINUED = r'([^.!?:;\n])\n([a-z("])'
SENTENCE_END = r"([.!?])[ \t\r]+"
LIST_START = r":[ \t\r]+([A-Z])"
VERSION = r"([ (])v\.[ \t]*([0-9])"
SPDX_TAG = r"SPDX-License-Identifier:[ \t]*"
SPDX_LATER = r"(SPDX-License-Identifier [ \t(]*[A-Z]+-[0-9.]+)\+"
SPDX_LINE = "(SPDX-License-Identifier [^\n\x01]*)"
_IDS = "|".join(re.escape(x) for x in sorted(SPDX, key=lambda x: (-len(x), x)))
SPDX_NEXT = rf"\)*[ \t]+(?:OR|AND)[ \t]+\(*({_IDS})"
SPDX_WITH = r"[ \t]+WITH[ \t]+([A-Za-z0-9.-]*-(?:exception|note))"
NOT_ALNUM = "[^a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    return re.sub(NOT_ALNUM, " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


#: Ends a sentence within a line.
MARK = "\x01"
#: Who a clause names stands for the copyright holder.
HOLDER = ("neither[ \n]the[ \n]name[ \n]of[ \n][a-z0-9 \n\x01]{1,100}?[ \n\x01]nor[ \n]the[ \n]names[ \n]of[ \n]",
          "neither the name of the copyright holder nor the names of ")
#: Steps on a given text, in order: pattern and replacement ($1: group).
STEPS = [(SPDX_TAG, MARK + "SPDX-License-Identifier "), (SPDX_WITH, MARK + "with $1"),
         (SPDX_NEXT, MARK + "SPDX-License-Identifier $1"), (SPDX_LATER, "$1-or-later"), (SPDX_LINE, "$1" + MARK),
         (VERSION, "$1v $2"), (CONTINUED, "$1 $2"), (SENTENCE_END, "$1" + MARK), (LIST_START, ":" + MARK + "$1")]
#: Steps on a text in lower case: comment marks and indentation become blanks, lines without words go.
NORMAL_STEPS = [(f"[^a-z0-9\n{MARK}]+", " "), (" *\n[ \n]*", "\n"), (f"[ \n]*{MARK}[ \n{MARK}]*", MARK)]
#: Any known sentence from the start of a sentence or line to the end of one, the longest first.
KNOWN = (f"(?<![^\n{MARK}])(?:" + "|".join(
    normalised(s).replace(" ", "[ \n]") for s in sorted(SENTENCES.values(), key=lambda s: -len(normalised(s))))
    + f")(?![^\n{MARK}])")


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (normalised(s), name)])
    # a mark that no text holds stands for the end of a sentence within a line
    lines = F.translate(F.coalesce(text, F.lit("")), MARK, "\x02")
    for pattern, by in STEPS:
        lines = F.regexp_replace(lines, pattern, by)
    lines = F.translate(lines, UPPER, LOWER)
    for pattern, by in NORMAL_STEPS:
        lines = F.regexp_replace(lines, pattern, by)
    lines = F.regexp_replace(F.trim(lines), *HOLDER)
    found = F.regexp_extract_all(lines, F.lit(KNOWN), F.lit(0))
    return F.transform(found, lambda s: F.element_at(known, F.translate(s, "\n", " ")))


def matched_rules(ids: Column) -> Column:
    """Licences of the rules that the identifiers fulfil, in the rules' order."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in parts)).alias("ids"))
                      for name, parts in RULES])
    start = F.struct(F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">")))).alias("left"),
                     F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        found = F.when(F.contains(state["left"], rule["ids"]),
                       F.concat(state["found"], F.array(rule["name"]))).otherwise(state["found"])
        return F.struct(F.replace(state["left"], rule["ids"], F.lit("<>")).alias("left"), found.alias("found"))

    return F.when(F.size(ids) > 0, F.aggregate(rules, start, apply, lambda s: s["found"])).otherwise(
        F.array().cast("array<string>"))


def find_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with license_sentences (identifiers in order) and licenses."""
    named = docs.withColumn("license_sentences", sentence_ids(F.col("text")))
    return named.withColumn("licenses", F.array_sort(F.array_distinct(matched_rules(F.col("license_sentences")))))


def license_report(docs: DataFrame) -> DataFrame:
    return find_licenses(docs.select("doc_id", "text")).select(
        "doc_id", F.size("license_sentences").cast("long").alias("n_sentences"),
        F.concat_ws(",", "license_sentences").alias("sentences"),
        F.size("licenses").cast("long").alias("n_licenses"), F.concat_ws(",", "licenses").alias("licenses"))
