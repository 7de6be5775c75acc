"""Graphs that change: a journal of additions and removals, and rules kept up to date by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.engine import TRIPLE, Engine

JOURNAL = "seq long, op string, s string, p string, o string, g string"


class Journal:
    """An append-only log of ``add`` and ``remove``; the graph is what was added last. A version is a
    sequence number, so going back is reading less of the log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, changes: DataFrame) -> None:
        """(op, s, p, o, g), in the order of ``seq``."""
        changes.select("seq", "op", "s", "p", "o", "g").write.mode("append").parquet(self.path)

    def entries(self, version: int | None = None) -> DataFrame:
        log = self.spark.read.schema(JOURNAL).parquet(self.path)
        return log if version is None else log.where(F.col("seq") <= version)

    def graph(self, version: int | None = None) -> DataFrame:
        """The quads as of a version."""
        last = self.entries(version).groupBy("s", "p", "o", "g").agg(F.max_by("op", "seq").alias("op"))
        return last.where("op = 'add'").select("s", "p", "o", "g")

    def rollback(self, version: int) -> None:
        """Appends what undoes everything after a version."""
        now, then = self.graph(), self.graph(version)
        top = self.entries().agg(F.max("seq")).first()[0] or 0
        undo = now.exceptAll(then).withColumn("op", F.lit("remove")).union(then.exceptAll(now).withColumn("op", F.lit("add")))
        self.append(undo.select(F.lit(top + 1).alias("seq"), "op", "s", "p", "o", "g"))

    def stream(self, files_per_batch: int = 1) -> DataFrame:
        return self.spark.readStream.schema(JOURNAL).option("maxFilesPerTrigger", files_per_batch).parquet(self.path)


class Changes:
    """Tells subscribers of changes. ``subscribe`` takes the kinds of events that a function wants, all by default;
    a function that returns False stops the dispatch of that event."""

    def __init__(self):
        self.wanted: list[tuple[frozenset[str], Callable[[str, DataFrame], object]]] = []

    def subscribe(self, fn: Callable[[str, DataFrame], object], *kinds: str) -> None:
        self.wanted.append((frozenset(kinds), fn))

    def dispatch(self, kind: str, quads: DataFrame) -> int:
        """Calls the subscribers in the order of their subscription; returns how many heard of it."""
        heard = 0
        for kinds, fn in self.wanted:
            if not kinds or kind in kinds:
                heard += 1
                if fn(kind, quads) is False:
                    break
        return heard


class LiveClosure:
    """The closure of a growing set of facts. Each micro-batch derives only from what is new and writes its
    facts and consequences to a folder of its own, replaced if the batch is repeated; what is known is what the
    folders hold, so a restarted process goes on where it was. Rules with negation can't be continued and are refused."""

    def __init__(self, spark: SparkSession, engine: Engine, path: str):
        self.spark, self.engine, self.path = spark, engine, path

    @property
    def done(self) -> list[int]:
        """The batches that are written."""
        jvm, at = self.spark.sparkContext._jvm, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return []
        folders = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("batch=")]
        whole = [f for f in folders if files.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
        return sorted(int(f.getName().removeprefix("batch=")) for f in whole)

    def _read(self, batches: list[int]) -> DataFrame:
        schema = "s string, p string, o string"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/batch={b}" for b in batches]) if batches else self.spark.createDataFrame([], schema)

    def triples(self) -> DataFrame:
        return self._read(self.done)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        known = self._read([b for b in self.done if b != batch_id])
        added = batch.select(*TRIPLE).distinct().join(known, TRIPLE, "left_anti")
        derived = self.engine.run(known, added).derived.select(*TRIPLE)
        added.union(derived).distinct().write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def follow(self, triples: DataFrame, checkpoint: str):
        """Starts a query that keeps the closure up to date with a stream of triples; available data first."""
        return triples.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
