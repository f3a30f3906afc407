"""Accuracy of an approximate result (A10), parameter sweeps (M12) and their
report (M13)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.itemsets import min_count_for
from basketry.functions.itemsets import contains_all
from basketry.operators.candidates import rarest_anchor, support_upper_bound

SWEEP_SCHEMA = ("sweep string, param_label string, param_value double, algorithm string, "
                "run int, measure string, value double")


def accuracy(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """A10 -> one row ``(not_identified, approx_overhead, approx_alpha_mean)``.

    * not_identified: share of exact itemsets contained in no approximate one;
    * approx_overhead: |approx| / |exact|;
    * approx_alpha_mean: mean over approximate itemsets of approx support /
      exact support, the exact support being the J8 bound (min support of
      exact subsets) when the itemset is not in the exact result; itemsets
      with no bound are left out of the mean.

    One union of per-itemset indicator rows and a single aggregate, no cross
    join of scalars. Measures that would divide by nothing (no exact
    itemsets) are null.
    """
    ex = exact.select("items", "support").distinct()
    ap = approx.select("items", F.col("support").alias("a_support")).distinct()
    sup = ap.select(F.col("items").alias("sup"))
    sub = rarest_anchor(ex.select(F.col("items").alias("sub")), sup)
    probe = sup.select("sup", F.explode("sup").alias("anchor"))
    inside = (sub["anchor"] == probe["anchor"]) & contains_all("sup", "sub")
    covered = sub.join(probe, inside, "left_semi").select(F.col("sub").alias("items")).withColumn("covered", F.lit(1))
    ex_rows = ex.join(covered, "items", "left").select(
        F.lit(1).alias("is_exact"), F.coalesce("covered", F.lit(0)).alias("covered"),
        F.lit(0).alias("is_approx"), F.lit(None).cast("double").alias("ratio"))
    direct = ap.join(ex.withColumnRenamed("support", "e_support"), "items", "left")
    bounded = support_upper_bound(direct.where(F.col("e_support").isNull()).select("items", "a_support"),
                                  ex)
    found = direct.where(F.col("e_support").isNotNull()).select(
        (F.col("a_support") / F.col("e_support")).alias("ratio"))
    guessed = bounded.select((F.col("a_support") / F.col("bound")).alias("ratio"))
    ap_rows = found.unionByName(guessed).select(
        F.lit(0).alias("is_exact"), F.lit(0).alias("covered"), F.lit(1).alias("is_approx"), "ratio")
    allr = ex_rows.unionByName(ap_rows)
    agg = allr.agg(F.sum("is_exact").alias("ne"), F.sum("covered").alias("nc"),
                   F.sum("is_approx").alias("na"), F.avg("ratio").alias("alpha_mean"))
    return agg.select(F.try_divide(F.col("ne") - F.col("nc"), F.col("ne")).alias("not_identified"),
                      F.try_divide(F.col("na"), F.col("ne")).alias("approx_overhead"),
                      F.col("alpha_mean").alias("approx_alpha_mean"))


def _timed(fn):
    t0 = time.time()
    out = fn()
    return out, time.time() - t0


def sweep(spark: SparkSession, baskets: DataFrame, sweep_name: str, param: str, values: list,
          base: dict | None = None, algorithms=("exact", "fpgrowth", "sampled"),
          runs: int = 1) -> DataFrame:
    """Vary one of ``alpha``, ``epsilon``, ``ratio`` (the threshold) or
    ``fraction`` (data size) and run the exact miner (M1), FP-growth (M4,
    as the reference, all frequent itemsets) and the sampled miner (M2).

    Supports are anti-monotone and closedness knows no threshold, so per data set and
    run the exact miner and FP-growth mine once, at the lowest threshold that the grid asks of
    it; a higher one filters that result by support. ``time`` of such a cell is the shared run's plus
    the filter's; FP-growth's ``sets_time`` (mining) and ``closed_time`` (closed
    filter) stand apart. Each run is a Spark job; only timings and one-row accuracies
    reach the driver. Returns the long result table (``SWEEP_SCHEMA``)."""
    from basketry.operators.candidates import closed_only
    from basketry.operators.sampling import sample_baskets
    from basketry.plans.approx import approx_closed_itemsets
    from basketry.plans.closed import closed_itemsets
    from basketry.plans.frequent import frequent_itemsets_fp
    from basketry.session import cut

    grid = [{"ratio": 0.7, "epsilon": 0.1, "alpha": 0.1, "fraction": 1.0} | (base or {}) | {param: v} for v in values]
    tables, lowest, mined, rows = {}, {}, {}, []
    for c in grid:
        f = c["fraction"]
        if f not in tables:
            data = cut(baskets if f >= 1.0 else sample_baskets(baskets, f, seed=7))
            tables[f] = data, data.count()
        mc = min_count_for(c["ratio"], tables[f][1])
        lowest[f] = min(mc, lowest.get(f, mc))

    def shared(kind: str, f: float, r: int, mine):
        """The result of one run at the lowest threshold of a data set, and its time."""
        if (kind, f, r) not in mined:
            mined[kind, f, r] = _timed(lambda: cut(mine(tables[f][0], min_count=lowest[f], n=tables[f][1])))
        return mined[kind, f, r]

    def measured(c: dict, r: int):
        data, n = tables[c["fraction"]]
        mc = min_count_for(c["ratio"], n)
        above = F.col("support") >= F.lit(mc)
        known, t_exact = shared("exact", c["fraction"], r, closed_itemsets)
        exact = known.where(above)
        n_exact, t_filter = _timed(exact.count)

        def errors(found: DataFrame):
            acc = accuracy(found, exact).first()
            return [(k, float(acc[k]) if acc[k] is not None else None)
                    for k in ("not_identified", "approx_overhead", "approx_alpha_mean")]

        if "exact" in algorithms:
            yield "exact", [("time", t_exact + t_filter), ("num_cis", float(n_exact))]
        if "fpgrowth" in algorithms:
            known, t_sets = shared("fpgrowth", c["fraction"], r, frequent_itemsets_fp)
            found = known.where(above)
            _, t_closed = _timed(closed_only(found.select("items", "support")).count)
            yield "fpgrowth", [("time", t_sets + t_closed), ("sets_time", t_sets), ("closed_time", t_closed), *errors(found)]
        if "sampled" in algorithms:
            found, t_sampled = _timed(lambda: cut(approx_closed_itemsets(data, mc, c["epsilon"], c["alpha"], n=n)))
            yield "sampled", [("time", t_sampled), *errors(found)]

    for c in grid:
        for r in range(runs):
            for algorithm, found in measured(c, r):
                rows += [(sweep_name, param, float(c[param]), algorithm, r, m, v) for m, v in found]
    return spark.createDataFrame(rows, SWEEP_SCHEMA)


ALGORITHMS = ("exact", "fpgrowth", "sampled")


def sweep_report(results: DataFrame, axis: dict[float, str] | None = None, flat: tuple = ()) -> DataFrame:
    """Mean over runs per (sweep, parameter, algorithm, measure), one
    column per algorithm (pivot on the known algorithm names).

    ``axis`` names the parameter values in the order of the plot: the report then has
    the label as ``axis`` and its 1-based ``place``, and values without a name are left out.
    ``flat`` lists algorithms that do not depend on the parameter: their column is the mean
    over the whole sweep, the same baseline at every place."""
    means = (results.groupBy("sweep", "param_label", "param_value", "measure", "algorithm")
                    .agg(F.avg("value").alias("mean_value")))
    out = (means.groupBy("sweep", "param_label", "param_value", "measure")
                .pivot("algorithm", list(ALGORITHMS))
                .agg(F.first("mean_value")))
    if flat:
        level = out.groupBy("sweep", "param_label", "measure").agg(*[F.avg(a).alias(f"flat_{a}") for a in flat])
        out = out.join(level, ["sweep", "param_label", "measure"]).drop(*flat)
        out = out.withColumnsRenamed({f"flat_{a}": a for a in flat})
    kept = ["sweep", "param_label", "param_value", "measure", *ALGORITHMS]
    if axis is None:
        return out.select(*kept)
    named = F.create_map(*[x for k, (v, label) in enumerate(axis.items(), 1)
                           for x in (F.lit(float(v)), F.struct(F.lit(label).alias("axis"), F.lit(k).alias("place")))])
    out = out.withColumn("named", F.element_at(named, F.col("param_value"))).where(F.col("named").isNotNull())
    return out.select(*kept[:3], "named.axis", "named.place", *kept[3:])
