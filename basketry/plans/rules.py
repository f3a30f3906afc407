"""Association rules with multi-item consequents (M8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.encoding import maybe_broadcast
from basketry.session import cut


def association_rules(frequent: DataFrame, min_conf: float = 0.7) -> DataFrame:
    """M8: every rule X -> Z \\ X with X a non-empty proper subset of a
    frequent Z and confidence support(Z) / support(X) >= ``min_conf``.

    ``frequent`` must be complete (every subset of a frequent set present),
    e.g. from M4 or M11. Consequents grow level by level: the confidence falls
    as the consequent grows, so only consequents of rules that pass are
    extended, by later items that pass alone. Each rule appears once, and an
    itemset may have any size. Antecedent supports come from an equi join.
    """
    f = frequent.select("items", "support")
    known = f.select(F.col("items").alias("antecedent"), F.col("support").alias("a_support"))
    n_known = f.count()

    def passing(candidates: DataFrame) -> DataFrame:
        """Candidates (z, support, consequent, ...) with enough confidence."""
        rules = candidates.withColumn("antecedent", F.array_except("z", "consequent")).join(
            maybe_broadcast(known, n_known), "antecedent")
        conf = F.col("support").cast("double") / F.col("a_support")
        return rules.withColumn("confidence", conf).where(F.col("confidence") >= F.lit(float(min_conf)))

    z = f.where(F.size("items") >= 2).select(F.col("items").alias("z"), "support")
    first = cut(passing(z.select("z", "support", F.explode("z").alias("e"))
                        .withColumn("consequent", F.array("e"))))
    alone = first.groupBy("z").agg(F.sort_array(F.collect_list("e")).alias("alone"))
    out = first
    level = first.join(alone, "z")
    while True:
        later = F.filter("alone", lambda e: e > F.element_at(F.col("consequent"), -1))
        longer = (level.select("z", "support", "alone", "consequent", F.explode(later).alias("e"))
                  .select("z", "support", "alone", F.concat("consequent", F.array("e")).alias("consequent"))
                  .where(F.size("consequent") < F.size("z")))
        level = cut(passing(longer))
        if level.isEmpty():
            break
        out = out.unionByName(level, allowMissingColumns=True)
    return out.select("antecedent", "consequent", "support", "confidence")
