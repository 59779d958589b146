"""A result log that is resumed: tasks arrive as a stream of files, those that are done are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def task_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Tasks from JSON-lines files as they come into ``folder``."""
    return spark.readStream.schema(schema).json(folder)


def run_resumed(tasks: DataFrame, log: str, checkpoint: str, work, key: str = "variant_id") -> StreamingQuery:
    """Applies ``work`` (DataFrame to DataFrame with ``key``) to tasks that the parquet log at ``log`` doesn't hold.

    Every micro-batch writes to its own folder of the log, so a batch that is run again after a failure
    replaces its rows; a task that is delivered twice is done once.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        todo = df.dropDuplicates([key])
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(log)
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            done = spark.read.option("basePath", log).parquet(log)
            if "batch" in done.columns:
                done = done.where(f"batch <> {n}")
            todo = todo.join(done.select(key).distinct(), key, "left_anti")
        work(todo).write.mode("overwrite").parquet(f"{log.rstrip('/')}/batch={n}")

    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
