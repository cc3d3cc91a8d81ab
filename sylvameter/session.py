"""Session defaults and the few helpers that need a live session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch: list[list[str]] = []  # tables of the open scratch blocks


def local_session(cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    n = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("sylvameter")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is used only when no folder is configured, which is the case in local tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sylvameter-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place for a table or folder of tables of this application in the shared folder; ``clean`` deletes it."""
    return f"{shared_folder(spark)}/sylvameter-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4()}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from its files, which cuts the lineage.

    A table is computed once (a checkpoint twice) and brings its true size to the planner, where a checkpoint brings
    estimates that multiply over rounds of joins. Tables stay until ``clean`` or the end of a ``scratch`` block.
    """
    spark = df.sparkSession
    path = f"{shared_path(spark, 'table')}.parquet"
    for held in _scratch:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system that Spark can write."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder on any file system that Spark can read."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes within the block are deleted at its end; results must be written by then."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.pop()  # blocks nest
        for path in paths:
            remove(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that ``materialise`` wrote in this application; DataFrames that read them are void."""
    remove(spark, f"{shared_folder(spark)}/sylvameter-{spark.sparkContext.applicationId}")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for steps that are dear by row.

    Only an input of fewer splits than cores is dealt anew, which is a small one; any other is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application, unless their search path has it already.

    Python workers import it by name. With ``PYTHONPATH`` or ``spark.submit.pyFiles`` set, nothing is sent.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(context.applicationId)
    if not (root / "sylvameter").is_dir():  # it came in an archive itself
        return
    archive = Path(tempfile.mkdtemp(prefix="sylvameter-ship-")) / "sylvameter-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "sylvameter").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
