"""Word streams: the identity-mode operators are stateless, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inflecta.functions import text as T


def stream_tokens(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token, garbage) of a batch or streaming DataFrame of texts."""
    each = texts.select(F.col(id_col).alias("id"), F.posexplode(T.tokens(text_col)).alias("pos", "token"))
    return each.select("id", "pos", "token", T.is_garbage("token").alias("garbage"))


def read_texts(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet table `name` in a folder: a file, or a folder that files arrive in."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(f"{folder}/{name}")
    return stream.option("pathGlobFilter", name).parquet(folder)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Works off all that is there, exactly once per file over any number of calls, appending Parquet to `out`."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
