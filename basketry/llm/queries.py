"""The registered queries of the training-data operators, each over its whole
table with production parameters, and their DuckDB SQL where SQL can express
them."""

from __future__ import annotations

import public_tokenizers

from basketry.llm import (bpe, chat, decontaminate, jaccard_join, licenses, packing, quality, repair, secrets, suffix_dedup,
                          tokens, toxicity, whitening)
from basketry.llm.common import table

# --------------------------------------------------------------------------
# 1 chat formatting
# --------------------------------------------------------------------------

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], given.schema)
    return chat.chat_digest(chat.format_chats(given.unionByName(own)))


def _op1_sql() -> str:
    t = chat.ChatTemplate()
    escaped = rf"regexp_replace(text, '{t._pattern(r'(\\*)')}', '\1\\\2\3', 'g')"
    marks = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in t.markers.items())
    marks += f" ELSE {sum(map(len, t.other))} + length({escaped.replace('(text,', '(role,')}) END"
    allowed = " OR ".join(f"(before = '{s}' AND role IN ({', '.join(repr(r) for r in rs)}))"
                          for s, rs in t.transitions.items())
    accept = ", ".join(map(repr, t.accept))
    loss = ", ".join(map(repr, t.loss))
    return f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, coalesce(lag(role) OVER w, '') AS before,
         lead(role) OVER w IS NULL AS ends
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role IN ({loss})), '') AS loss,
         CAST(sum(length({escaped}) + {marks}) AS BIGINT) AS formatted_chars,
         CAST(coalesce(min(place) FILTER (NOT ({allowed})),
                       min(place + 1) FILTER (ends AND role NOT IN ({accept}))) AS BIGINT) AS error_turn
  FROM placed GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       error_turn IS NULL AS valid, error_turn
FROM chats"""


# --------------------------------------------------------------------------
# 2 benchmark decontamination
# --------------------------------------------------------------------------

def op2_decontaminate(spark, sf_dir):
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op2_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = (rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), "
             r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, words[i:i + 9] AS w, len(words[i:i + 9]) AS n
  FROM (SELECT *, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i FROM items WHERE len(words) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
runs AS (
  SELECT r, i, n, words[i:i + n - 1] AS w
  FROM (SELECT r, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)),
hits AS (SELECT r, i, runs.n, item FROM runs JOIN windows ON runs.n = windows.n AND runs.w = windows.w),
places AS (SELECT r, count(DISTINCT i + k) AS n_hit
           FROM (SELECT DISTINCT r, i, unnest(generate_series(0, n - 1)) AS k FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
          FROM hits GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN found USING (r)"""


# --------------------------------------------------------------------------
# 3 quality rules
# --------------------------------------------------------------------------

def op3_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


_SPACES = r"[\x20\x09-\x0D]+"
QUALITY_SQL = rf"""
words AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACES}'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
         len(string_split(coalesce(text, ''), chr(10))) AS n_lines,
         row_number() OVER () AS r
  FROM {{documents}}),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT r, words, unnest(generate_series(1, len(words) - 7)) AS i FROM words WHERE len(words) > 8)),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY r),
features AS (
  SELECT doc_id, text, words, n_lines, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words
  FROM words LEFT JOIN repeats ON words.r = repeats.r),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         10 * n_symbols > n_words
         OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
         OR 10 * len(list_filter(words, lambda w, i: i > 1 AND w = words[i - 1])) > 3 * n_words
         OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 2 * length(regexp_replace(text, '\P{{{{Lu}}}}+', '', 'g')) > length(regexp_replace(text, '\P{{{{L}}}}+', '', 'g'))
         OR 10 * length(regexp_replace(text, '\P{{{{L}}}}+', '', 'g')) < 6 * word_chars AS rejected
  FROM features)"""


def _op3_sql() -> str:
    return f"""
WITH {QUALITY_SQL.format(documents="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged"""


# --------------------------------------------------------------------------
# 4 secret scans
# --------------------------------------------------------------------------

def op4_secret_scan(spark, sf_dir):
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------
# 5 toxicity
# --------------------------------------------------------------------------

def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --------------------------------------------------------------------------
# 6 packing
# --------------------------------------------------------------------------

def op6_packing(spark, sf_dir):
    return packing.packing_report(table(spark, sf_dir, "documents"), VOCABULARY)


# --------------------------------------------------------------------------
# 7 n-gram Jaccard join
# --------------------------------------------------------------------------

def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------
# 8 license scans
# --------------------------------------------------------------------------

def op8_license_scan(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    known = ", ".join(f"('{licenses.normalised(s)}', '{name}')" for name, s in licenses.SENTENCES.items())
    steps, last = [], "named"
    for k, (name, parts) in enumerate(licenses.RULES):
        pattern = "".join(f"<{x}>" for x in parts)
        steps.append(f"rule{k} AS MATERIALIZED (SELECT r, doc_id, n, ids, replace(seq, '{pattern}', '<>') AS seq, "
                     f"CASE WHEN contains(seq, '{pattern}') THEN list_append(found, '{name}') ELSE found END AS found "
                     f"FROM {last})")
        last = f"rule{k}"
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def replaced(x: str, pairs) -> str:
        for pattern, by in pairs:
            x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(by.replace('$', chr(92)))}, 'g')"
        return x

    # every separator twice, so that each sentence has two of its own and needs no look around
    mark = licenses.MARK
    sentences = "|".join(licenses.normalised(s).replace(" ", "(?: |\n\n)")
                         for s in sorted(licenses.SENTENCES.values(), key=lambda s: -len(licenses.normalised(s))))
    given = replaced(f"translate(coalesce(text, ''), '{mark}', '\x02')", licenses.STEPS)
    lines = replaced(f"translate({given}, '{licenses.UPPER}', '{licenses.LOWER}')", licenses.NORMAL_STEPS)
    lines = replaced(f"trim({lines}, ' ')", [licenses.HOLDER])
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, {lines} AS lines FROM documents),
hits AS (SELECT r, regexp_extract_all('\n' || regexp_replace(lines, '([\n{mark}])', '\\1\\1', 'g') || '\n',
                                      {quoted(f"[\n{mark}](?:{sentences})[\n{mark}]")}) AS parts
         FROM docs),
sentences AS (SELECT r, i, replace(trim(parts[i], '\n{mark}'), '\n\n', ' ') AS sentence
              FROM (SELECT r, parts, unnest(generate_series(1, len(parts))) AS i FROM hits)),
found AS (SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY i) AS ids,
                 string_agg('<' || name || '>', '' ORDER BY i) AS seq
          FROM sentences JOIN known USING (sentence) GROUP BY r),
named AS (SELECT r, doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, coalesce(seq, '') AS seq,
                 CAST([] AS VARCHAR[]) AS found FROM docs LEFT JOIN found USING (r)),
{", ".join(steps)}
SELECT doc_id, n AS n_sentences, ids AS sentences, len(list_distinct(found)) AS n_licenses,
       array_to_string(list_sort(list_distinct(found)), ',') AS licenses
FROM {last}"""


# --------------------------------------------------------------------------
# 9 token counts
# --------------------------------------------------------------------------

#: The vocabulary file of the token queries, and the limit they report on.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 512


def op9_token_counts(spark, sf_dir):
    return tokens.token_report(table(spark, sf_dir, "documents"), VOCABULARY, TOKEN_LIMIT)


# --------------------------------------------------------------------------
# 10 suffix-array dedup
# --------------------------------------------------------------------------

def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


# --------------------------------------------------------------------------
# 11 embedding whitening
# --------------------------------------------------------------------------

def op11_whitening(spark, sf_dir):
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


# --------------------------------------------------------------------------
# 12 BPE encoding and decoding
# --------------------------------------------------------------------------

def op12_bpe(spark, sf_dir):
    return bpe.bpe_report(table(spark, sf_dir, "documents"), VOCABULARY)


# --------------------------------------------------------------------------
# 13 conversation structure repair
# --------------------------------------------------------------------------

def op13_conversation_repair(spark, sf_dir):
    return repair.repair_report(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_bpe": op12_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}

SQL = {
    "op1_chat_format": _op1_sql(),
    "op2_decontaminate": _op2_sql(),
    "op3_quality_rules": _op3_sql(),
    "op8_license_scan": _op8_sql(),
}
