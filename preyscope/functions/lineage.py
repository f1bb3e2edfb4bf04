"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    A session in one process (master local) that names none gets a folder of its own; on a cluster that would be one
    that the executors can't see, so it is an error there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        one_process = context.master.startswith("local") and not context.master.startswith("local-cluster")
        if not named and not one_process:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="preyscope-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder: what follows plans and reads that table, not what led to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: what follows reads the columns it needs, compressed."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a written table that a task takes.
ROWS_OF_A_TASK = 1_000_000


def tasks_of(table: DataFrame, rows: int = ROWS_OF_A_TASK) -> int:
    """Tasks for a written table, of about so many rows: their number grows with it, not their size."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), table.count() // rows + 1)


class Workspace:
    """Tables of one computation in the shared folder, which are removed with it, after an error too.

    A table that a later one replaces can be dropped before. What outlives the computation has to be cut() or written
    elsewhere before the workspace closes.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self._paths, self._named = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}", {}, []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *error: object) -> None:
        for name in self._named:
            self.spark.sql(f"drop table if exists {name}")
        self._delete(self.folder)

    def keep(self, df: DataFrame, sort: str | None = None) -> DataFrame:
        """df as a table: reread, so that filters and columns reach its scan. By ranges of a column if one is named."""
        path = f"{self.folder}/{len(self._paths)}"
        (df.repartitionByRange(sort).sortWithinPartitions(sort) if sort else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[len(self._paths)] = (out, path)
        return out

    def deal(self, df: DataFrame, buckets: int, *keys: str) -> DataFrame:
        """df as a table in buckets of the keys, a file each: joins and groups by these keys read it without a shuffle."""
        name = f"dealt_{uuid.uuid4().hex}"
        self._named.append(name)
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for out, path in self._paths.values():
            if any(out is t for t in tables):
                self._delete(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
