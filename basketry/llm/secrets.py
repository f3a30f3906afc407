r"""Secret scans: an Aho-Corasick automaton of keywords runs over all bytes,
regular expressions are tried only at its hits, and kinds with an embedded
checksum must pass it.

Kinds, in this order: assign (a name such as password or token, then : or =, then
12 or more value characters), access (AKIA and capitals or digits, 18 or more),
hex (16 or more of 0-9a-f), and beyond these base kinds github and npm (tokens
whose last six characters are the base-62 CRC-32 of the rest), jwt (its header
decodes to JSON with an algorithm) and pem (private key blocks). Spans are in
code points, the end exclusive, leftmost and non-overlapping within a kind;
spans of different kinds may overlap.

Defined results: a null or empty text has no spans; repeated rows are scanned
each for themselves; texts are scanned whole, whatever their length; an empty
table gives no rows. ``redact`` keeps every column and changes the text alone
(and ``n_chars`` if there is such a column); a null text stays null.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common as C

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = C.byte_set((0x30, 0x39), (0x61, 0x66))
LEAST_HEX = 16


def _checksum(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    body, n, out = m[1][:-6], zlib.crc32(m[1][:-6]), b""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _DIGITS[digit:digit + 1] + out
    return len(body) > 0 and out == m[1][-6:]


def _header(m: re.Match) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (ValueError, TypeError):
        return False


#: kind -> (keywords, lower case; expression anchored at the keyword; test of a match)
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"),
               re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
               lambda m: len(m[1]) >= 12),
    "access": (("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
               _checksum),
    "npm": (("npm_",), re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _checksum),
    "jwt": (("eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"), _header),
    "pem": (("-----begin",), re.compile(rb"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*"
                                        rb"-----END ([A-Z0-9]+ )*PRIVATE KEY-----"), lambda m: True),
}


#: Kinds whose expression begins with a run of these bytes and nothing else decides there:
#: what fails at one keyword of the run fails at all of them.
RUNS = {"jwt": re.compile(rb"[A-Za-z0-9_-]*")}


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (keywords, _, _) in RULES.items():
        for word in keywords:
            out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def _scan(automaton, data: np.ndarray, offsets: np.ndarray):
    """(document, kind, start, end) in bytes of a chunk; no order."""
    raw = data.tobytes()
    hits = sorted((end - n + 1, kind) for end, (n, kind) in automaton.iter(C.LOWER[data].tobytes().decode("latin-1")))
    done, found = {}, []
    docs = np.searchsorted(offsets, [h[0] for h in hits], "right") - 1
    for (start, kind), doc in zip(hits, docs.tolist()):
        if start < done.get(kind, 0):
            continue
        _, expression, accepts = RULES[kind]
        m = expression.match(raw, start, int(offsets[doc + 1]))
        if m:
            done[kind] = m.end()
            if accepts(m):
                found.append((doc, kind, start, m.end()))
        elif kind in RUNS:
            # a run is read once, however many keywords it holds
            done[kind] = RUNS[kind].match(raw, start, int(offsets[doc + 1])).end()
    starts, ends, first = C.word_bounds(data, offsets, _HEX)
    long = np.flatnonzero(ends - starts >= LEAST_HEX)
    docs = np.searchsorted(first, long, "right") - 1
    return found + [(d, "hex", s, e) for d, s, e in zip(docs.tolist(), starts[long].tolist(), ends[long].tolist())]


def _document_spans(column: pa.Array) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, kind number, end) in code points, sorted."""
    automaton, out = _automaton(), [[] for _ in range(len(column))]
    for row, data, offsets in C.chunks(column):
        for doc, kind, start, end in sorted(_scan(automaton, data, offsets)):
            a, b = int(offsets[doc]), int(offsets[doc + 1])
            spans = out[row + doc]
            if not spans:
                points = np.concatenate([[0], np.cumsum((data[a:b] & 0xC0) != 0x80)])
            spans.append((int(points[start - a]), KINDS.index(kind), int(points[end - a])))
    for spans in out:
        spans.sort()
    return out


def _found(batches):
    for batch in batches:
        spans = _document_spans(batch.column(1))
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end), sorted by start, then kind."""
    C.small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _found, f"doc_id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each maximal run of overlapping spans becomes one mark of its first kind."""
    out, at, end = [], 0, 0
    for start, kind, stop in spans:
        if start >= end:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        end = max(end, stop)
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by a mark of its kind."""
    C.small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            changed = {i: s for i, s in enumerate(_document_spans(column)) if s}
            if changed:
                values = column.to_pylist()
                for i, spans in changed.items():
                    values[i] = _redacted(values[i], spans)
                batch = batch.set_column(place, batch.schema.field(place), pa.array(values, column.type))
            yield batch

    out = docs.mapInArrow(run, docs.schema)
    if length in docs.columns:
        kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(text).isNull(), F.col(length)).otherwise(F.length(text).cast(kind)))
    return out.select(*docs.columns)


def secrets_report(docs: DataFrame) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return find_secrets(docs).select("doc_id", *[count(k) for k in BASE_KINDS],
                                     F.sha2(joined(base), 256).alias("base_sha256"),
                                     joined(F.col("spans")).alias("spans"))
