"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset and all is one machine.

    On a cluster without such a folder it raises: executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='inflecta-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes of input for each core below which a table is dealt out anew.
SMALL = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small: small files are often one row group, which only one task can read.

    Large tables come in many row groups and stay where they are; the rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL * cores else df


#: Bytes of stored texts for each part that what is found in them is dealt into.
PART = 2 << 20


def parts_of(df: DataFrame) -> int:
    """Parts for what is made of texts: their number grows with the texts, so that no part does. Rows of unknown size don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 50)
    return max(df.sparkSession.sparkContext.defaultParallelism, min(size // PART, 20_000))


#: Rows up to which a table is sent whole to every executor.
FEW = 50_000


def meet(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with a written table, which is broadcast if it has few rows; else both sides are sorted, and hot keys split.

    Spark goes by the size of a table's files, in which words take a tenth of what they take in memory, however often they are
    exploded behind them; by that it would send the words of a corpus through the driver. rows never go there.
    """
    few = table.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(table), on, how) if few else by_sort(rows, table, on, how)


def by_sort(rows: DataFrame, others: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the corpus: neither is sent to the driver."""
    return rows.hint("merge").join(others, on, how)


_tables: list[str] = []
_forgotten = 0


def generation() -> int:
    """Grows each time that tables are forgotten: what was written under a smaller number is gone."""
    return _forgotten


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read back. Computed once; survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that this process has written; what was computed from them can't be computed again."""
    global _forgotten
    _forgotten += 1
    jvm = spark.sparkContext._jvm
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
