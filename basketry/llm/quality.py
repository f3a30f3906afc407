r"""Quality rules: a short-circuit cascade of document rules. DataFrame functions
only.

``cascade`` measures every rule's cost and rejection rate on a bounded sample,
orders the rules by rejection per cost and builds one CASE expression that
stops at a document's first rejecting rule. The order changes the time taken,
never the verdict.

Words are runs of [^\x20\x09-\x0D]. Defined results: a null text is empty, an
empty text has no words and fails the base rule; a rule that gives null does
not reject; repeated rows are judged each for themselves; an empty table gives
no rows; other columns are kept, and none is read but the text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"#*$%&|<>"
#: Words of a window in the repetition rule.
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Most copies of a sample's rows in the measurement of a cheap rule.
COPIES = 64


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def symbol_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", ""))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeated_words(words: Column) -> Column:
    """Words inside windows of 8 words that the text holds at least twice."""
    def doubled(hashes: Column, step: int) -> Column:
        """Hashes of runs twice as long, from those of runs of ``step`` words."""
        places = F.sequence(F.lit(0), F.size(hashes) - F.lit(step + 1))
        return F.transform(places, lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + step)))

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            def same(i: Column, j: Column) -> Column:
                return F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            places = F.sequence(F.lit(0), F.size(s) - 1)
            return F.transform(F.filter(places, lambda i: same(i, i - 1) | same(i, i + 1)),
                               lambda i: F.get(s, i)["i"])

        def add(done: Column, i: Column) -> Column:
            return F.struct((done["n"] + WINDOW - F.greatest(done["end"] - i, F.lit(0))).alias("n"),
                            (i + WINDOW).alias("end"))

        starts = F.sort_array(let(ordered, repeats))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add)["n"]

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered(windows))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counted = let(hashes, lambda a: let(doubled(a, 1), lambda b: let(doubled(b, 2), lambda c: let(
        doubled(c, 4), of_windows))))
    return F.when(F.size(words) > WINDOW, counted).otherwise(0)


def stuttered_words(words: Column) -> Column:
    """Words equal to the word before them."""
    return let(words, lambda a: F.size(F.filter(a, lambda w, i: w == F.get(a, i - 1))))


def features(text: Column, words: Column) -> dict[str, Column]:
    return {"n_words": F.size(words), "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": symbol_count(text), "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": let(words, repeated_words)}


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def base_rules(f: dict[str, Column]) -> list[Rule]:
    return [Rule("short", f["n_words"] < 20),
            Rule("repeated_windows", 100 * f["n_repeat_words"] > 30 * f["n_words"])]


def content_rules(text: Column, words: Column, f: dict[str, Column]) -> list[Rule]:
    """The rules beyond the base ones; ratios of the whole text."""
    text = F.coalesce(text, F.lit(""))
    n = f["n_words"]
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    lines = F.size(F.split(text, "\n"))
    return [Rule("symbols", 10 * f["n_symbols"] > n),
            Rule("duplicate_lines", (f["n_dup_lines"] >= 3) & (10 * f["n_dup_lines"] > 3 * lines)),
            Rule("stutter", 10 * stuttered_words(words) > 3 * n),
            Rule("word_length", (f["word_chars"] < 2 * n) | (f["word_chars"] > 15 * n)),
            Rule("capitals", 2 * capitals > letters),
            Rule("few_letters", 10 * letters < 6 * f["word_chars"])]


def _seconds(sample: DataFrame, copies: int, condition: Column, least: float = 0.0, runs: int = 3) -> float:
    """Median time of a condition on ``copies`` of each row of the sample; a first run, which
    compiles the code, is left out. A run that takes less than ``least`` is the last, and its
    time is given."""
    rows = sample.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    counted, taken = rows.agg(F.count_if(condition)), []
    for _ in range(runs + 1):
        began = time.perf_counter()
        counted.collect()
        taken.append(time.perf_counter() - began)
        if taken[1:] and taken[-1] < least:
            return taken[-1]
    return median(taken[1:])


def rule_costs(sample: DataFrame, rules: list[Rule]) -> dict[str, float]:
    """Seconds of each rule on the sample, by its conditions alone: the rows are repeated
    until a rule takes twice what the same rows take without one (or ``COPIES`` times). Rules that
    add less than half of that even so cannot be told apart by their time and cost the same."""
    idle, costs = {}, {}
    for rule in rules:
        copies = 4
        while True:
            if copies not in idle:
                idle[copies] = _seconds(sample, copies, F.lit(True))
            taken = _seconds(sample, copies, rule.rejects, 2 * idle[copies] if copies < COPIES else 0.0)
            if taken >= 2 * idle[copies] or copies >= COPIES:
                break
            copies *= 4
        costs[rule.name] = max(taken - idle[copies], 0.5 * idle[copies]) / copies
    return costs


def by_rejection_per_cost(rules: list[Rule], verdicts: list[tuple[tuple, int]], costs: dict[str, float]) -> list[Rule]:
    """At each place the rule that rejects most per cost of the rows that the rules before it
    let through (``verdicts``: each combination of verdicts, in the rules' order, and its rows);
    rules that reject none of them come last, the cheapest first."""
    out, left, open_rules = [], list(verdicts), list(range(len(rules)))
    while open_rules:
        def worth(i: int) -> tuple:
            return sum(n for v, n in left if v[i]) / costs[rules[i].name], -costs[rules[i].name]
        best = max(open_rules, key=worth)
        out.append(rules[best])
        open_rules.remove(best)
        left = [(v, n) for v, n in left if not v[best]]
    return out


def cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = 500, seed: int = 11) -> list[Rule]:
    """The rules in order of rejection per cost, measured on a sample of about
    ``sample_rows`` documents (a bound on the measurement alone: the ordered
    rules judge every document and give the same verdicts in any order). The sample is
    one partition, so that a time is that of the rows and not of many small tasks."""
    total = docs.count()
    sample = docs.sample(fraction=min(1.0, sample_rows / max(total, 1)), seed=seed).repartition(1).persist()
    try:
        named = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
        counted = sample.select(*named).groupBy(*[f"r{i}" for i in range(len(rules))]).count().collect()
        verdicts = [(tuple(row)[:-1], row["count"]) for row in counted]
        return by_rejection_per_cost(rules, verdicts, rule_costs(sample, rules))
    finally:
        sample.unpersist()


def first_rejection(ordered: list[Rule]) -> Column:
    """Name of the first rejecting rule, null for a document that passes all;
    the rules after it are not evaluated."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in ordered:
        out = out.when(rule.rejects, F.lit(rule.name))
    return out


def all_rules(text: Column, words: Column) -> list[Rule]:
    f = features(text, words)
    return base_rules(f) + content_rules(text, words, f)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``rejected_by``: null for the documents to keep. The words
    are bound once for all rules, also where a filter on the verdict is moved
    below this projection."""
    t = F.col(text)
    order = [r.name for r in cascade(docs.select(text).withColumn("__words", words_of(t)),
                                     all_rules(t, F.col("__words")))]

    def verdict(words: Column) -> Column:
        rules = {r.name: r for r in all_rules(t, words)}
        return first_rejection([rules[name] for name in order])

    return docs.withColumn("rejected_by", let(words_of(t), verdict))


def quality_report(docs: DataFrame) -> DataFrame:
    """Base features of every document, the base verdict, and ``kept``."""
    split = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    text, words = F.col("text"), F.col("words")
    f = features(text, words)
    counted = split.select("doc_id", "text", "words", *[c.cast("long").alias(k) for k, c in f.items()])
    seen = {k: F.col(k) for k in f}
    order = [rule.name for rule in cascade(counted.drop("doc_id"), content_rules(text, words, seen))]
    failed = F.lit(False)
    for rule in base_rules(seen):
        failed = failed | rule.rejects
    rules = {rule.name: rule for rule in content_rules(text, words, seen)}
    verdict = first_rejection([rules[name] for name in order])
    return counted.select("doc_id", *f, failed.alias("base_failed"),
                          (~failed & verdict.isNull()).alias("kept"))
