"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    The same as submitting it with ``--py-files``: the driver may have found the package on
    a path that executors do not have.
    """
    context = spark.sparkContext
    if getattr(context, "_reelgate_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "reelgate.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._reelgate_shipped = True
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and let joins split a hot key even ahead of another exchange.

    Joins here attach one row per series or artist to many; where that side is too large to
    broadcast, a key that holds most rows is split at run time instead of landing in one task.
    """
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return ship_package(spark)


def local_session(cores: int | str = 8, name: str = "reelgate") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition rows by keys for work in Python or on files, several tasks per core.

    Adaptive execution merges partitions by their bytes, and a path weighs next to nothing: what
    is dear about such a row lies behind it. A number that is asked for is not merged.
    """
    spark = df.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, as the cluster names it.

    Only a local master, whose executors are this very process, may fall back to a
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    # a core setting cannot be changed in a running session, so the folder is kept beside it
    context = spark.sparkContext
    if not hasattr(context, "_reelgate_folder"):
        context._reelgate_folder = tempfile.mkdtemp(prefix="spark-")
    return context._reelgate_folder


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it from there.

    Every later read sees the same rows, computed once, and survives lost executors; being
    columnar, the table also serves readers that need only some of its columns. The table is
    needed for as long as results that follow from it are read; ``scratch`` and ``release`` free it.
    """
    path = f"{shared_dir(df.sparkSession)}/pinned-{uuid4().hex}"
    _steps(df.sparkSession).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _steps(spark: SparkSession) -> list[str]:
    """The stored steps of this application that have not been freed."""
    context = spark.sparkContext
    if not hasattr(context, "_reelgate_steps"):
        context._reelgate_steps = []
    return context._reelgate_steps


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the stored steps but the first ``keep``; frames that read them become unusable."""
    steps = _steps(spark)
    gone, steps[keep:] = steps[keep:], []
    for name in gone:
        discard(spark, name)
    return len(gone)


def discard(spark: SparkSession, name: str) -> None:
    """Delete a stored folder, in whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Free all steps stored inside the block at its end, when its results have been written."""
    before = len(_steps(spark))
    try:
        yield
    finally:
        release(spark, before)
