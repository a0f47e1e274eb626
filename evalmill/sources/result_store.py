"""The result store as a table laid out by a hash of its key, which batches and streams write to.

The table is bucketed by the key, and every bucket is a partition of its own.  So a join on the key needs no shuffle on
the store's side, and an upsert reads and writes only the buckets that it touches; files of others stay as they are.

A write goes in steps, each of which can be repeated: merged buckets are written to a staging folder as a whole; they take
the places of the old ones, one rename each; the batch is entered in the ledger; the staging folder goes.  After a break the
next writer finishes a complete staging folder and drops an incomplete one, and a batch in the ledger is not written again,
so that a stream that is killed anywhere and started again gives what one undisturbed batch gives.

One writer at a time.  A reader that began before a write and has not opened its files yet may have to start again.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .shared import Files
from .store import latest, require

BUCKETS = 64
PART = "store_part"


class ResultStore:
    """Rows by key, the newest of each; ``order`` tells which is newer (null is oldest), and of equal ones the later write.

    A store that is there keeps its number of buckets, whatever is asked for.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "run_key", order: str = "created_at", buckets: int = BUCKETS):
        if PART in schema.names or not {key, order} <= set(schema.names):
            raise ValueError(f"the schema needs {key} and {order}, and no {PART}")
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.files = Files(spark, path)
        found = [int(n.split("-")[1]) for n in self.files.names(self.path) if n.startswith("rows-")]
        self.buckets = found[0] if found else buckets
        self.rows_path = f"{self.path}/rows-{self.buckets}"
        self.files.make(self.rows_path)
        self.table = f"results_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}, {PART} int) USING parquet PARTITIONED BY ({PART}) "
            f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{self.rows_path}'"
        )
        for name in self.files.names(f"{self.path}/staging"):
            self._finish(name)
        self._refresh()

    # ------------------------------------------------------------ reading

    def read(self) -> DataFrame:
        return self.spark.table(self.table).select(*self.schema.names)

    def pending(self, plan: DataFrame) -> DataFrame:
        """Planned work whose key is not there yet; only the plan is shuffled."""
        return plan.join(self.read().select(self.key), self.key, "left_anti")

    def written(self) -> list[str]:
        """Batches that the ledger has."""
        return self.files.names(f"{self.path}/ledger")

    # ------------------------------------------------------------ writing

    def upsert(self, new: DataFrame, batch: str | None = None) -> bool:
        """The newest row of each key, old or new.  ``batch``: a name; a batch that was written is left out (False)."""
        newer = F.col(f"_n_{self.order}") >= F.col(self.order)
        return self._write(new, batch, F.coalesce(newer, F.col(self.order).isNull()))

    def insert_ignore(self, new: DataFrame, batch: str | None = None) -> bool:
        """New rows whose key is not there yet."""
        return self._write(new, batch, F.lit(False))

    def sink(self, rows: DataFrame, checkpoint: str, name: str = "stream") -> StreamingQuery:
        """Upserts a stream, as far as its source has come; every batch is written once."""
        write = rows.writeStream.foreachBatch(lambda df, i: self.upsert(df, f"{name}-{i}"))
        return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def part_of(self, key: Column) -> Column:
        """The bucket of a key, by the rule by which Spark deals rows into buckets."""
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def _write(self, new: DataFrame, batch: str | None, replaces: Column) -> bool:
        if batch is not None and batch in self.written():
            return False
        name = f"batch={batch}" if batch is not None else f"once={uuid.uuid4().hex}"
        if not self._staged(name):
            self.files.delete(self._staging(name))
            self._stage(new, name, replaces)
        self._finish(name)
        self._refresh()
        return True

    def _stage(self, new: DataFrame, name: str, replaces: Column) -> None:
        spark, names = new.sparkSession, self.schema.names
        spark.sql(f"REFRESH TABLE {self.table}")  # a stream has a session of its own, which knows earlier files
        fresh = require(new.select(*names), f"`{self.key}` is not null", "a row without a key")
        fresh = latest(fresh, self.key, self.order).withColumn(PART, self.part_of(F.col(self.key)))
        fresh = fresh.toDF(*(f"_n_{c}" for c in fresh.columns)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = [r[0] for r in fresh.select(f"_n_{PART}").distinct().collect()]  # no more than there are buckets
            old = spark.table(self.table).where(F.col(PART).isin(touched))
            both = old.join(fresh, F.col(self.key) == F.col(f"_n_{self.key}"), "full_outer")
            takes = F.col(f"_n_{self.key}").isNotNull() & (F.col(self.key).isNull() | replaces)
            merged = both.select(*(F.when(takes, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in [*names, PART]))
            draft = f"{self.table}_{uuid.uuid4().hex[:8]}"
            write = merged.write.partitionBy(PART).bucketBy(self.buckets, self.key).sortBy(self.key)
            write.option("path", self._staging(name)).format("parquet").saveAsTable(draft)
            spark.sql(f"DROP TABLE {draft}")  # the files stay
        finally:
            fresh.unpersist()

    def _staging(self, name: str) -> str:
        return f"{self.path}/staging/{name}"

    def _staged(self, name: str) -> bool:
        return self.files.exists(f"{self._staging(name)}/_SUCCESS")

    def _finish(self, name: str) -> None:
        staging = self._staging(name)
        if self._staged(name):
            for part in self.files.names(staging):
                if part.startswith(f"{PART}="):
                    self.files.move(f"{staging}/{part}", f"{self.rows_path}/{part}")
            if name.startswith("batch="):
                self.files.mark(f"{self.path}/ledger/{name.removeprefix('batch=')}")
        self.files.delete(staging)

    def _refresh(self) -> None:
        self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")
        self.spark.sql(f"REFRESH TABLE {self.table}")
