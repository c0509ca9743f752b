"""Session helpers: defaults for new sessions and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Texts cost far more per byte than rows of numbers: keep all cores busy on small inputs.
    # On large ones the share per core exceeds this bound anyway.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def local_session(cores: int | str = "*", app: str = "pagewright", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster supplies its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Apply to a given session those defaults that results or small inputs depend on."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.coalescePartitions.minPartitionSize"):
        spark.conf.set(key, DEFAULTS[key])


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, whose executors
    share the machine, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scope: ContextVar[list[str] | None] = ContextVar("pagewright_scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
    if (made := _scope.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables made inside, once their results are written. Results that
    are still to be computed from them must not leave the block."""
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in made:
            target = hadoop(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, survives executor loss, and gives the planner the true size of the
    result, so that a later join is broadcast only when the table is really small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Not needed where the package is installed on the cluster or passed with --py-files.
    """
    context = spark.sparkContext
    if getattr(context, "_pagewright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._pagewright_shipped = True


def spread(df: DataFrame, bytes_per_core: int = 64 * 1024 * 1024) -> DataFrame:
    """Spread a small input over all cores.

    A small table often is one file with one row group, which one core would have to work
    through alone. Tables with plenty of data for every core are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * bytes_per_core else df
