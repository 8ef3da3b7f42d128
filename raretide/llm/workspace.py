"""Written intermediate tables in the shared folder that the cluster names.

Iterative operators cut their lineage by writing a table and reading it back, so that a lost executor costs a
re-read and not a recomputation of everything before it. Large intermediate tables are deleted as soon as nothing
pending reads them; what a returned DataFrame still needs is a checkpoint(), which Spark itself tracks.
"""

from __future__ import annotations

import itertools
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a private one only in local mode, where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone at interpreter exit
        pass


#: Rows and bytes of an Arrow batch: Spark's defaults are meant for narrow rows and would hold tens of megabytes of
#: text on each side of every Python worker. A session that names its own number keeps it.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"))


class Workspace:
    """A private folder under the shared one. Use as a context manager; leaving it deletes its tables."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = itertools.count()
        self._paths: dict[int, str] = {}
        self._end = weakref.finalize(self, _delete, spark, self.root)
        for key, default, rows in BATCHES:
            if spark.conf.get(key) == default:
                spark.conf.set(key, rows)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self._end()

    def path(self, name: str) -> str:
        return f"{self.root}/{next(self._count):03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the table as read back."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing pending reads any more."""
        for t in tables:
            if path := self._paths.pop(id(t), None):
                _delete(self.spark, path)

    def keep(self, df: DataFrame) -> DataFrame:
        """A reliable checkpoint that outlives this workspace, for what a result still reads."""
        context = self.spark.sparkContext
        if not context.getCheckpointDir():
            context.setCheckpointDir(shared_folder(self.spark))
        return df.checkpoint()
