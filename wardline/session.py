"""Session settings and durable intermediate results."""

from __future__ import annotations

from types import ModuleType

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession

# Settings that may change at run time.  Adaptive execution picks broadcast or
# sort-merge joins from real sizes and splits skewed join partitions, also where
# the split costs one more shuffle of partial aggregates.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate results.

    It is the one named in ``spark.checkpoint.dir``; where that is unset, a folder in the warehouse, which
    executors share too.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Partitions and their row order are kept, and lost executors do not cost the
    result.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    """Partitions for a table that many Python passes will read.

    The shuffle setting of the cluster, and never fewer than its cores; locally
    no more than the cores, since each pass starts every task again.
    """
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cores = spark.sparkContext.defaultParallelism
    local = spark.sparkContext.master.startswith("local")
    return min(wanted, cores) if local else max(wanted, cores)


def ship(module: ModuleType) -> None:
    """Send this module's functions along with the tasks that use them.

    Executors then need no copy of the package.
    """
    register_pickle_by_value(module)
