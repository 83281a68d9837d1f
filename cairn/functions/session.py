"""The folder that all executors share, cutting lineage in it, and dealing rows out to tasks."""

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: about so many rows meet in a task that folds or sorts rows of numbers.
TASK_ROWS = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's checkpoint folder. Where neither is set, only a local master gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all machines share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "/tmp/checkpoints"


def settle(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, rows: int | None, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """`df`, of some `rows` rows, by its keys over as many tasks as `task_rows` asks for. Rows of numbers shrink to a few bytes in a shuffle, so partitions that are
    joined up to a number of bytes hold ever more of them as the input grows. Tables with few rows, or of a size that is not known, stay as they are."""
    tasks = -(-(rows or 0) // task_rows)
    return df.repartition(tasks, *keys) if tasks > 1 else df
