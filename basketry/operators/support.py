"""Containment matching (J1, J2) and support / closure counting.

Matching a candidate itemset against baskets is a theta join (containment).
We turn it into an equi join on one *anchor* item: the candidate's rarest
item (its first code, as codes rank items rarest first). A basket is exploded
into one probe row per item, the probe joins the candidates with that anchor,
and a containment filter keeps the real matches. Each (candidate, basket)
pair is produced exactly once, and only baskets holding the rarest item are
probed, which keeps hot items ("the") out of the join.

* ``broadcast`` (J1): candidates are broadcast (rows and bytes checked; beyond them the
  join shuffles), the exploded baskets stream through a hash join with no shuffle.
* ``shuffle`` (J2): baskets of few codes meet the candidates on the anchor as bits of a long, a hot
  anchor's in parts (``match_bits``); of many codes, row numbers, not code arrays, meet them on the
  anchor, or on two items where the anchor is hot (``match_rows``).

Bits of codes are compared first: up to ``MASK_CODES`` codes they decide, beyond that
only pairs whose bits agree have their arrays compared.

Closure is computed by co-counting: explode each matched basket, sum weights
per (candidate, item); the items whose co-count equals the support form the
closure. Every aggregate combines map-side, and lists of codes come in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.itemsets import contains_all, explode_items
from basketry.operators.encoding import (BROADCAST_BYTES, BROADCAST_ROWS, UNMEASURED_ROWS, Encoded, counted_items, decode,
                                         encode, encode_baskets, encode_itemsets, item_codes, maybe_broadcast, table_bytes)
from basketry.session import cut, persisted


# Probe restriction: used when baskets can be wide (more codes than
# PROBE_RESTRICT_MIN_CODES) and the distinct anchors fit a literal list.
PROBE_RESTRICT_MIN_CODES = 64
ANCHOR_LITERAL_MAX = 4096

# Codes in one row of co-counts.
CODES_PER_ROW = 1024

# Codes that have a bit each in a long.
MASK_CODES = 63

# Of an anchor's baskets that are dealt out, a part has about this many at least.
PART_ROWS = 10_000

# An anchor is hot when its baskets times its candidates are more than this.
HOT_PAIRS = 10_000_000


def _choose(strategy: str, cand_rows: int, limit: int) -> str:
    if strategy == "auto":
        return "broadcast" if cand_rows <= limit else "shuffle"
    if strategy not in ("broadcast", "shuffle", "index"):
        raise ValueError(f"unknown strategy {strategy!r}")
    return "shuffle" if strategy == "index" else strategy


def bits(col: str) -> Column:
    """A bit per code (modulo ``MASK_CODES``) of an array of codes, in one long."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.col(col), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(
        F.call_function("shiftleft", one, (c % MASK_CODES).cast("int"))))


def holds_bits() -> Column:
    """The basket's bits ``_held`` hold the candidate's ``_needs``: with at most ``MASK_CODES``
    codes the containment itself, else what it implies."""
    return F.col("_held").bitwiseAND(F.col("_needs")) == F.col("_needs")


def match_codes(enc_baskets: DataFrame, cands: DataFrame, cand_rows: int,
                strategy: str = "auto", limit: int = BROADCAST_ROWS,
                n_codes: int | None = None, cand_bytes: int | None = None) -> DataFrame:
    """Pairs (candidate, basket) with the candidate contained in the basket.

    ``enc_baskets`` has ``codes`` (+ any other columns, e.g. ``weight``);
    ``cands`` has ``cand`` (sorted codes) and optionally ``anchor`` (its
    rarest code); without it the first code is the anchor (codes ranked
    rarest first). Candidates are broadcast only where their bytes, given as a
    bound or measured, allow it.
    """
    how = _choose(strategy, cand_rows, limit)
    if how == "broadcast" and cand_bytes is None and (cand_rows > UNMEASURED_ROWS or strategy == "broadcast"):
        cand_bytes = table_bytes(cands)
    if how == "broadcast" and (cand_bytes or 0) > BROADCAST_BYTES:
        how = "shuffle"
    c = cands if "anchor" in cands.columns else cands.withColumn("anchor", F.element_at("cand", 1))
    probe_codes = F.col("codes")
    if how == "broadcast" and (n_codes is None or n_codes > PROBE_RESTRICT_MIN_CODES):
        # only codes that anchor some candidate can match: probe wide baskets
        # with those alone (native hash intersection), not with every code
        anchors = [r[0] for r in c.select("anchor").distinct().limit(ANCHOR_LITERAL_MAX + 1).collect()]
        if len(anchors) <= ANCHOR_LITERAL_MAX:
            lit = F.array(*[F.lit(a) for a in sorted(anchors)]).cast(enc_baskets.schema["codes"].dataType)
            probe_codes = F.array_intersect("codes", lit)
    by_bits = n_codes is not None and n_codes <= MASK_CODES
    if how == "shuffle":
        return match_bits(enc_baskets, c) if by_bits else match_rows(enc_baskets, c)
    probe = enc_baskets.withColumn("_held", bits("codes")).select("*", F.explode(probe_codes).alias("anchor"))
    met = probe.join(F.broadcast(c.withColumn("_needs", bits("cand"))), "anchor").where(holds_bits())
    return (met if by_bits else met.where(contains_all("codes", "cand"))).drop("anchor", "_held", "_needs")


def match_bits(enc_baskets: DataFrame, cands: DataFrame, hot_pairs: int | None = None) -> DataFrame:
    """The pairs of ``match_codes`` by an index of codes that fit ``MASK_CODES`` bits.

    The index holds (code, bits) with the basket's columns that are asked for; a candidate meets the baskets
    of its anchor and compares bits there, so no pair moves again. The baskets of a hot anchor
    (times its candidates above ``hot_pairs``) are dealt to parts, each with a copy of the candidates.
    """
    hot_pairs = HOT_PAIRS if hot_pairs is None else hot_pairs
    index = (enc_baskets.withColumn("_held", bits("codes")).withColumn("_row", F.monotonically_increasing_id())
             .select("*", F.explode("codes").alias("anchor")))
    load = (enc_baskets.select(F.explode("codes").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("_rows"))
            .join(cands.groupBy("anchor").agg(F.count(F.lit(1)).alias("_cands")), "anchor"))
    # at most one row per code
    parts = F.broadcast(cut(load.select("anchor", (1 + F.least(
        F.floor(F.col("_rows") * F.col("_cands") / F.lit(max(hot_pairs, 1))), F.floor(F.col("_rows") / F.lit(PART_ROWS))))
        .cast("long").alias("_parts"))))
    index = index.join(parts, "anchor").withColumn("_part", F.pmod("_row", "_parts")).drop("_row", "_parts")
    dealt = (cands.withColumn("_needs", bits("cand")).join(parts, "anchor")
             .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts"))
    return index.join(dealt, ["anchor", "_part"]).where(holds_bits()).drop("anchor", "_part", "_held", "_needs")


def match_rows(enc_baskets: DataFrame, cands: DataFrame, hot_pairs: int | None = None) -> DataFrame:
    """The pairs of ``match_codes`` by an index of row numbers.

    The index holds (code, row) and no code arrays. A candidate meets the rows of its
    anchor. Where an anchor is hot (rows times candidates above ``hot_pairs``), candidates of two
    or more items are met by two items instead: the anchor and their rarest other code
    (the first, as codes rank rarest first), against the rows' pairs of that anchor and another code.
    Only pairs whose bits agree are kept. Pairs (row, candidate) whose candidate has further items
    are then checked against the row's codes, which move once, to their row number.
    """
    hot_pairs = HOT_PAIRS if hot_pairs is None else hot_pairs
    rows = cut(enc_baskets.withColumn("_row", F.monotonically_increasing_id()))
    cands = cut(cands.withColumn("_cand", F.monotonically_increasing_id()))
    held = rows.select("_row", "codes", bits("codes").alias("_held"))
    index = held.select("_row", "_held", F.explode("codes").alias("anchor"))
    load = (index.groupBy("anchor").agg(F.count(F.lit(1)).alias("_rows"))
            .join(cands.groupBy("anchor").agg(F.count(F.lit(1)).alias("_cands")), "anchor"))
    hot = cut(load.where(F.col("_rows") * F.col("_cands") > F.lit(hot_pairs)).select("anchor"))
    hot = maybe_broadcast(hot, hot.count())
    narrow = cands.select("_cand", "cand", "anchor", bits("cand").alias("_needs"))
    paired = F.size("cand") > 1
    by_two = (narrow.where(paired).join(hot, "anchor", "left_semi")
                    .withColumn("other", F.element_at(F.array_remove("cand", F.col("anchor")), 1)))
    by_one = narrow.where(~paired).unionByName(narrow.where(paired).join(hot, "anchor", "left_anti"))
    first = (index.join(by_one.select("_cand", "anchor", "_needs", F.size("cand").alias("_items")), "anchor")
             .where(holds_bits()).select("_row", "_cand", "_items"))
    two = (held.select("*", F.explode("codes").alias("anchor")).join(hot, "anchor", "left_semi")
               .select("_row", "_held", "anchor", F.explode(F.array_remove("codes", F.col("anchor"))).alias("other")))
    second = (two.join(by_two.select("_cand", "anchor", "other", "_needs", (F.size("cand") - 1).alias("_items")),
                       ["anchor", "other"]).where(holds_bits()).select("_row", "_cand", "_items"))
    met = first.unionByName(second)
    whole = cands.drop("anchor")
    pairs = met.join(rows, "_row").join(whole, "_cand")
    return pairs.where((F.col("_items") == 1) | contains_all("codes", "cand")).drop("_row", "_cand", "_items")


def with_anchor(cands: DataFrame, enc_baskets: DataFrame) -> DataFrame:
    """Add each candidate's rarest code as ``anchor``, from the code supports
    of the (folded, small) encoded baskets."""
    sup = (enc_baskets.select(F.explode("codes").alias("code"), "weight")
                      .groupBy("code").agg(F.sum("weight").alias("s")))
    x = cands.select("cand", F.explode("cand").alias("code")).join(sup, "code")
    a = x.groupBy("cand").agg(F.min_by("code", F.struct("s", "code")).alias("anchor"))
    return cands.join(a, "cand")


def rarest_code(cands: DataFrame, codes: DataFrame, n_codes: int) -> DataFrame:
    """Add each candidate's rarest code as ``anchor``, from the code table's
    supports (for codes that do not rank rarest first)."""
    x = cands.select("cand", F.explode("cand").alias("code"))
    x = x.join(maybe_broadcast(codes.select("code", "support"), n_codes), "code")
    a = x.groupBy("cand").agg(F.min_by("code", F.struct("support", "code")).alias("anchor"))
    return cands.join(a, "cand")


def support_codes(enc: Encoded, cands: DataFrame, cand_rows: int,
                  strategy: str = "auto") -> DataFrame:
    """(cand, support) for coded candidates (with their ``anchor`` when given);
    zero-support ones are absent."""
    keep = ["cand", "anchor"] if "anchor" in cands.columns else ["cand"]
    pairs = match_codes(enc.baskets, cands.select(*keep), cand_rows, strategy, n_codes=enc.n_codes)
    return pairs.groupBy("cand").agg(F.sum("weight").alias("support"))


def closure_parts(enc: Encoded, cands: DataFrame, cand_rows: int,
                  ext_min: int | None = None, strategy: str = "auto",
                  cand_bytes: int | None = None) -> DataFrame:
    """(cand, chunk, support, closure[, ext]) for coded candidates, a row per candidate and
    chunk of ``CODES_PER_ROW`` codes that occur with it.

    ``closure`` holds the chunk's codes that all matched baskets share, ``ext`` (when
    ``ext_min`` is given) those outside the closure whose co-count reaches
    ``ext_min``: the frequent one-item extensions. No row lists more codes than a chunk has.
    """
    pairs = match_codes(enc.baskets, cands.select("cand"), cand_rows, strategy, n_codes=enc.n_codes, cand_bytes=cand_bytes)
    co = (pairs.select("cand", F.explode("codes").alias("code"), "weight")
               .groupBy("cand", "code").agg(F.sum("weight").alias("cc")))
    per = (co.groupBy("cand", F.floor(F.col("code") / CODES_PER_ROW).cast("int").alias("chunk"))
             .agg(F.max("cc").alias("support"), F.collect_list(F.struct("code", "cc")).alias("co")))
    if enc.n_codes > CODES_PER_ROW:
        # a chunk without a code of the closure does not know the support
        known = per.groupBy("cand").agg(F.max("support").alias("support"))
        per = per.drop("support").join(known, "cand")
    sup = F.col("support")

    def codes_of(keep):
        return F.sort_array(F.transform(F.filter("co", keep), lambda s: s["code"]))

    cols = [F.col("cand"), F.col("chunk"), sup, codes_of(lambda s: s["cc"] == sup).alias("closure")]
    if ext_min is not None:
        cols.append(codes_of(lambda s: (s["cc"] < sup) & (s["cc"] >= F.lit(ext_min))).alias("ext"))
    return per.select(*cols)


def whole_closures(enc: Encoded, parts: DataFrame) -> DataFrame:
    """(cand, support, closure) of ``closure_parts``; a row is as long as the closure."""
    if enc.n_codes <= CODES_PER_ROW:
        return parts.select("cand", "support", "closure")
    return (parts.where(F.size("closure") > 0).groupBy("cand")
                 .agg(F.max("support").alias("support"),
                      F.sort_array(F.flatten(F.collect_list("closure"))).alias("closure")))


def closure_codes(enc: Encoded, cands: DataFrame, cand_rows: int, strategy: str = "auto") -> DataFrame:
    """(cand, support, closure) for coded candidates."""
    return whole_closures(enc, closure_parts(enc, cands, cand_rows, strategy=strategy))


# --------------------------------------------------------------------------
# Public operators on raw baskets / itemsets
# --------------------------------------------------------------------------

def _candidate_codes(candidates: DataFrame, col: str = "items"):
    """Codes (natural order) for the items named by the candidates; no pass
    over the baskets is needed."""
    citems = candidates.select(F.explode(col).alias("item")).distinct()
    codes = item_codes(citems.withColumn("support", F.lit(0).cast("long")), order="item")
    return codes, codes.count()


def match_candidates(baskets: DataFrame, candidates: DataFrame, strategy: str = "broadcast",
                     col: str = "items") -> DataFrame:
    """Pairs ``(items, basket_id)`` with the candidate contained in the
    basket. ``strategy='broadcast'`` (J1) or ``'index'`` (J2) give the same rows."""
    codes, n_codes = _candidate_codes(candidates, col)
    enc_b = cut(encode_baskets(baskets, codes, n_codes, keep_id=True))
    cands = cut(with_anchor(encode_itemsets(candidates, codes, n_codes, col), enc_b))
    n_c = cands.count()
    pairs = match_codes(enc_b, cands.select("cand", "anchor", col), n_c, strategy, n_codes=n_codes)
    return pairs.select(col, "basket_id")


def itemset_support(baskets: DataFrame, candidates: DataFrame, n: int | None = None,
                    min_count: int | None = None, strategy: str = "auto",
                    col: str = "items") -> DataFrame:
    """A3: support of each candidate (zero-support candidates are absent).

    One pass over the baskets: they are restricted to the candidate items and
    folded; anchors come from the folded baskets. With ``n`` also
    ``rel_support = support / n``; with ``min_count`` also ``is_frequent``.
    """
    codes, n_codes = _candidate_codes(candidates, col)
    enc = Encoded(codes, n_codes, cut(encode_baskets(baskets, codes, n_codes)), n or -1)
    cands = cut(with_anchor(encode_itemsets(candidates, codes, n_codes, col), enc.baskets))
    n_c = cands.count()
    sup = support_codes(enc, cands, n_c, strategy)
    out = cands.join(sup, "cand").select(col, "support")
    if n is not None:
        out = out.withColumn("rel_support", F.col("support") / F.lit(float(n)))
    if min_count is not None:
        out = out.withColumn("is_frequent", F.col("support") >= F.lit(int(min_count)))
    return out


def itemset_closure(baskets: DataFrame, candidates: DataFrame, strategy: str = "auto",
                    col: str = "items") -> DataFrame:
    """A4: ``(items, support, closure)`` per candidate with support > 0.

    Every item of closure(X) has support >= support(X), so the baskets are
    restricted to items at least as frequent as the rarest candidate support.
    """
    with persisted(baskets) as b:
        sup = cut(itemset_support(b, candidates, strategy=strategy, col=col))
        low = sup.agg(F.min("support")).first()[0]
        if low is None:
            return sup.select(col, "support", F.col(col).alias("closure")).limit(0)
        enc = encode(b, int(low), order="support", n=-1)
    cands = cut(encode_itemsets(sup, enc.codes, enc.n_codes, col))
    n_c = cands.count()
    cl = closure_codes(enc, cands, n_c, strategy=strategy)
    cl = decode(cl, enc.codes, enc.n_codes, "closure", "closure")
    return cands.join(cl, "cand").select(col, "support", "closure")


def dataset_closure(baskets: DataFrame) -> DataFrame:
    """A5: the items present in every basket, one row ``(closure)``."""
    counted = cut(counted_items(baskets))
    n = (counted.where(F.col("item").isNull()).first() or [None, 0])[1]
    common = counted.where(F.col("item").isNotNull() & (F.col("support") == F.lit(n)))
    return common.agg(F.sort_array(F.collect_list("item")).alias("closure"))


def grouped_closure(baskets: DataFrame, group_col: str = "grp", max_group=None,
                    within: list | None = None) -> DataFrame:
    """Per group, the intersection of its baskets (intersected with
    ``within`` if given); groups whose key exceeds ``max_group`` get ``[]``.

    One pass: every basket gives a row per item and one without an item, so one
    aggregate per (group, item) counts the items and the group's baskets; partial
    aggregation keeps a hot group at one row per task and item.
    """
    none = F.lit(None).cast(baskets.schema["items"].dataType.elementType)
    marked = F.concat(F.array_distinct("items"), F.array(none))
    x = baskets.select(group_col, F.explode(marked).alias("item"))
    if within is not None:
        x = x.where(F.col("item").isNull() | F.col("item").isin(list(within)))
    co = x.groupBy(group_col, "item").agg(F.count(F.lit(1)).alias("cc"))
    per = co.groupBy(group_col).agg(F.max("cc").alias("n_baskets"),
                                    F.collect_list(F.when(F.col("item").isNotNull(),
                                                          F.struct("item", "cc"))).alias("counted"))
    full = F.filter("counted", lambda c: c["cc"] == F.col("n_baskets"))
    closure = F.sort_array(F.transform(full, lambda c: c["item"]))
    if max_group is not None:
        closure = F.when(F.col(group_col) <= F.lit(max_group), closure).otherwise(
            F.array().cast(baskets.schema["items"].dataType))
    return per.select(group_col, closure.alias("closure"))


def frequent_among(baskets: DataFrame, items: DataFrame, threshold) -> DataFrame:
    """Of the listed items (a DataFrame ``item``), those with count
    strictly greater than ``threshold``."""
    listed = items.select("item").distinct()
    n_l = listed.count()
    x = explode_items(baskets).join(maybe_broadcast(listed, n_l), "item", "left_semi")
    return (x.groupBy("item").agg(F.count(F.lit(1)).alias("support"))
             .where(F.col("support") > F.lit(threshold)))
