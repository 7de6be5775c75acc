"""Written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}  # by application: the folders written since the last ``discard``


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder
    that goes with the process; on a cluster, where executors don't share one, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    own = spark.sparkContext.applicationId
    if own not in _OWN:
        _OWN[own] = tempfile.mkdtemp(prefix="quadrille-")
        atexit.register(shutil.rmtree, _OWN[own], ignore_errors=True)
    return _OWN[own]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new intermediate, which ``discard`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Deletes the intermediates written so far; returns how many there were. To be called when the results
    that read them have been consumed."""
    own = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in own:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(own)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read again: lineage ends here, and a lost
    executor costs a re-read rather than a recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by one written part a round. However many rounds, it is one scan of their files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_folder(spark, name)
        self.schema: StructType | None = None
        self.parts: list[int] = []
        self._next = 0

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Writes a part; returns it and its number of rows, counted while it is written."""
        seen = Observation()
        path = f"{self.root}/{self._next}"
        self.schema = df.schema
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        n = seen.get["n"]
        if n:
            self.parts.append(self._next)
        self._next += 1
        return self.spark.read.schema(self.schema).parquet(path), n

    def all(self) -> DataFrame | None:
        if not self.parts:
            return None
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{k}" for k in self.parts])
