"""Tables of a folder, JSON files, checked snapshots, and report sinks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def split(spark: SparkSession, folder: str, name: str, part: str) -> DataFrame:
    """One split of a dataset: every file folder/name/part-*.parquet, or the file folder/name.parquet where there are none."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}").getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = f"{folder}/{name}/{part}-*.parquet"
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern))
    return spark.read.parquet(pattern) if found else table(spark, folder, name)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A folder with one file that holds one JSON array of the records, for small results: more than ``most`` are an error
    (larger ones belong into JSON lines or Parquet, which executors write side by side)."""
    records = df.select(F.to_json(F.struct("*"))).limit(most + 1).collect()
    if len(records) > most:
        raise ValueError(f"more than {most} records")
    array = "[" + ",".join(f"\n{r[0]}" for r in records) + "\n]"
    df.sparkSession.createDataFrame([(array,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_lines(df: DataFrame, path: str, order: str, line: str = "line") -> None:
    """A folder of text files; read one after another, by name, they are in the given order."""
    df.orderBy(order).select(line).write.mode("overwrite").text(path)


def union_stores(stores: dict[str, DataFrame | None], notice: Callable[[str], None] = log.warning) -> DataFrame:
    """All stores with their name in ``store``; those that are missing (None) are left out, with a notice."""
    for name, df in stores.items():
        if df is None:
            notice(f"store {name} is missing")
    found = [df.withColumn("store", F.lit(name)) for name, df in stores.items() if df is not None]
    if not found:
        raise ValueError("no store is there")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def checksum(columns: dict[str, T.DataType]) -> list[Column]:
    """Aggregates that tell whether two tables hold the same rows, in whatever order: their number, and the sum and the
    exclusive or of two hashes of each row.  Maps count by their sorted entries, and a null is unlike an absent value."""

    def values(name: str, kind: T.DataType) -> list[Column]:
        c = F.col(f"`{name}`")
        if isinstance(kind, T.MapType):
            c = F.array_sort(F.map_entries(c))
        elif "map<" in kind.simpleString():
            c = F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType)) else c
        return [c.isNull(), c]

    row = [x for name in sorted(columns) for x in values(name, columns[name])]
    one, two = F.xxhash64(*row), F.xxhash64(F.lit(1), *row)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(one), F.lit(0)).alias("x"), F.coalesce(F.sum(two.cast("decimal(20,0)")), F.lit(0)).alias("s")]


def snapshot(df: DataFrame, path: str, least: int) -> int:
    """Writes the rows, reads them again and compares rows and content; the number of rows.

    Fewer than ``least`` rows, or others than were written, are an error and leave nothing behind.  The checksum of what is
    written is taken while it is written.  The snapshot that is there stands aside until the new one is in its place.
    """
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    target, draft, aside = (fs.Path(f"{path.rstrip('/')}{end}") for end in ("", ".draft", ".before"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(aside) and not system.exists(target):  # an earlier call broke off between its two renames
        system.rename(aside, target)
    sums = checksum({f.name: f.dataType for f in df.schema})
    written = Observation()
    df.observe(written, *sums).write.mode("overwrite").parquet(draft.toString())
    found = spark.read.schema(df.schema).parquet(draft.toString()).agg(*sums).first().asDict()
    wrong = f"{found['n']} rows, {least} expected" if found["n"] < least else "" if found == written.get else "the copy differs from what was written"
    if wrong:
        system.delete(draft, True)
        raise ValueError(wrong)
    system.delete(aside, True)
    if system.exists(target):
        system.rename(target, aside)
    system.rename(draft, target)
    system.delete(aside, True)
    return found["n"]


def show_table(df: DataFrame, limit: int = 200) -> str:
    """The first rows as an aligned text table, numbers to the right; printed and returned."""
    rows = [tuple(r) for r in df.limit(limit).collect()]  # what a console takes
    cells = [df.columns, *(["" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in r] for r in rows)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    right = [kind in ("int", "bigint", "double", "float", "smallint") for _, kind in df.dtypes]
    lines = ["  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(row, widths, right, strict=True)).rstrip() for row in cells]
    text = "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])
    print(text)
    return text


def missing_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def first_of(df: DataFrame, names: Iterable[str]) -> str:
    """The first of several possible column names that the data has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {list(names)} in {df.columns}")
