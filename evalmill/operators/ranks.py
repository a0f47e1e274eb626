"""Places in an order within large groups, without sorting a group in one task.

A row's place is the number of rows with a smaller value, those with the same value in earlier ranges of the key, and its
place in that range.  The first two are sums over counts, one for each value and each range that occur; only a range of
``SPAN`` keys is sorted at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

SPAN = 1 << 16


def placed(df: DataFrame, groups: list[str], value: str, key: str, name: str) -> DataFrame:
    """``df`` with the place of each row from 1, in the order of value and then key (an integer), within its group.

    Groups may be null; value and key may not.
    """
    rows = df.withColumn("_range", F.floor(F.col(key) / SPAN))
    ranges = rows.groupBy(*groups, value, "_range").agg(F.count("*").alias("_n"))
    values = ranges.groupBy(*groups, value).agg(F.sum("_n").alias("_m"))
    before = lambda line: line.rowsBetween(W.Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum("_m").over(before(W.Window.partitionBy(*groups).orderBy(value))), F.lit(0))
    earlier = F.coalesce(F.sum("_n").over(before(W.Window.partitionBy(*groups, value).orderBy("_range"))), F.lit(0))
    values = values.select(*groups, value, smaller.alias("_smaller"))
    ranges = ranges.select(*groups, value, "_range", earlier.alias("_earlier"))
    same = lambda one, other, names: [one[c].eqNullSafe(other[c]) for c in names]
    offsets = ranges.join(values, same(ranges, values, [*groups, value])).select(
        *(ranges[c] for c in [*groups, value, "_range"]), (F.col("_smaller") + F.col("_earlier")).alias("_before")
    )
    offsets = offsets.toDF(*(f"_o{i}" for i in range(len(groups) + 2)), "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate([*groups, value, "_range"])]
    inside = F.row_number().over(W.Window.partitionBy(*groups, value, "_range").orderBy(key))
    return rows.join(offsets, on).withColumn(name, (F.col("_before") + inside).cast("long")).select(*df.columns, name)


def at_share(df: DataFrame, group: str, value: str, places: dict[str, float]) -> DataFrame:
    """group, n, and for each name the value at place min(floor(share * n) + 1, n) of its group's order.
    Counts of values are ordered, not rows."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("_k"))
    line = W.Window.partitionBy(group).orderBy(value)
    upto = counts.withColumn("_to", F.sum("_k").over(line.rowsBetween(W.Window.unboundedPreceding, 0)))
    upto = upto.withColumn("n", F.sum("_k").over(W.Window.partitionBy(group)))
    at = lambda share: F.least(F.floor(F.col("n") * share) + 1, F.col("n"))
    found = [F.min(F.when(F.col("_to") >= at(share), F.col(value))).alias(name) for name, share in places.items()]
    return upto.groupBy(group).agg(F.max("n").alias("n"), *found)
