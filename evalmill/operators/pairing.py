"""Paired comparison of configurations on the same items.

Every comparison is one pass: rows of a group and item meet in one aggregation with a column for each configuration
that takes part, instead of joining the table with itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.functions import stats


def _outcomes(rows: DataFrame, groups: list[str], item: str, configs: list[str]) -> DataFrame:
    """An outcome column c0, c1, ... for each configuration; null where the item has no row of it."""
    picked = [F.max(F.when(F.col("config") == c, F.col("correct").cast("int"))).alias(f"c{i}") for i, c in enumerate(configs)]
    return rows.where(F.col("config").isin(*configs)).groupBy(*groups, item).agg(*picked)


def paired_counts(rows: DataFrame, groups: list[str], base: str, treatments: list[str], item: str = "item_id") -> DataFrame:
    """groups, config, n, n_base, n_comp, fixed, broken over items that both configurations have."""
    wide = _outcomes(rows, groups, item, [base, *treatments])
    each = F.array(*(F.struct(F.lit(t).alias("config"), F.col(f"c{i}").alias("y")) for i, t in enumerate(treatments, 1)))
    long = wide.where("c0 is not null").select(*groups, "c0", F.explode(each).alias("t")).select(*groups, "c0", "t.config", "t.y")
    return (
        long.where("y is not null")
        .groupBy(*groups, "config")
        .agg(
            F.count("*").alias("n"),
            F.sum("c0").alias("n_base"),
            F.sum("y").alias("n_comp"),
            F.count_if((F.col("c0") == 0) & (F.col("y") == 1)).alias("fixed"),
            F.count_if((F.col("c0") == 1) & (F.col("y") == 0)).alias("broken"),
        )
    )


def compared(counts: DataFrame) -> DataFrame:
    """Accuracies and their difference in percent, rounded half to even, with the exact p and its star."""
    p = stats.mcnemar_p(F.col("fixed"), F.col("broken"))
    pct = lambda k: F.bround(100.0 * F.col(k) / F.col("n")).cast("long")
    return counts.withColumns(
        {
            "base": pct("n_base"),
            "acc": pct("n_comp"),
            "d": F.bround(100.0 * (F.col("n_comp") - F.col("n_base")) / F.col("n")).cast("long"),
            "p": F.round(p, 10),
            "star": F.when(p < 0.05, "*").otherwise(""),
        }
    ).drop("n_base", "n_comp")


def with_interval(counts: DataFrame) -> DataFrame:
    """d, lo, hi and the verdict of every comparison."""
    ci = stats.delta_interval(F.col("fixed"), F.col("broken"), F.col("n"))
    out = counts.withColumn("ci", ci).select("*", *(F.round(f"ci.{x}", 6).alias(x) for x in ("d", "lo", "hi"))).drop("ci")
    return out.withColumn("verdict", stats.verdict(F.col("lo"), F.col("hi")))


def agreement(rows: DataFrame, groups: list[str], configs: list[str], item: str = "item_id") -> DataFrame:
    """Items on which all of several configurations agree."""
    wide = _outcomes(rows, groups, item, configs)
    names = [f"c{i}" for i in range(len(configs))]
    whole = wide.where(" and ".join(f"{n} is not null" for n in names))
    return whole.groupBy(*groups).agg(
        F.count("*").alias("n"), F.count_if(F.least(*names) == F.greatest(*names)).alias("n_agree")
    )


def buckets(rows: DataFrame, groups: list[str], configs: list[str], item: str = "item_id") -> DataFrame:
    """Items by what happened in three configurations."""
    wide = _outcomes(rows, groups, item, configs).where("c0 is not null and c1 is not null and c2 is not null")
    total = F.col("c0") + F.col("c1") + F.col("c2")
    what = (
        F.when(total == 3, "all ok").when(total == 0, "all fail")
        .when((F.col("c0") == 1) & (F.col("c1") == 0), F.when(F.col("c2") == 1, "hurt, recovered").otherwise("hurt, lost"))
        .when((F.col("c0") == 0) & (F.col("c1") == 1), "helped").otherwise("late change")
    )
    return wide.groupBy(*groups, what.alias("bucket")).agg(F.count("*").alias("n"))
