"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that hold on a laptop and on a cluster alike. Partition counts, memory and
# parallelism belong to the cluster's own configuration; AQE coalesces and splits
# shuffle partitions at run time, so no job hard-codes them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # files of a query's shuffles are removed when it ends
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app: str = "voxmart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``master`` is only set for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a small scan dealt to all cores. A file with one row group is read by one task, which would then do all the work
    on its rows; a scan with as many partitions as cores stays as it is, so nothing large is moved."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, as the cluster names it.

    A local run that names none uses a folder in its own warehouse. On a cluster a missing name is an error, since a
    folder of one machine would lose what other machines write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"


def scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/voxmart/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``clear_scratch`` removes all paths of this application."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remove_scratch(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            remove_path(table.sparkSession, file.rsplit("/", 1)[0])


def clear_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application, once their results are stored elsewhere."""
    remove_path(spark, scratch_root(spark))


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut_lineage(df: DataFrame, name: str, batch: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back. Python functions get ``batch`` rows at a time; ``options`` are those of the writer.

    The written table survives the loss of executors, and its statistics let the next
    stage choose its joins from real sizes. Nothing needs the shuffles before it any more: their files go.
    """
    path = scratch_path(df.sparkSession, name)
    with setting(df.sparkSession, **{CLEANUP: "true"}, **({ROWS: str(batch)} if batch else {})):
        df.write.options(**options).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
