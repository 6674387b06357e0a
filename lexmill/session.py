"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of an application started without it.

    The same as giving a zip of it to ``--py-files``; once per application.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="lexmill-ship-")) / "lexmill.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one ``spark.checkpoint.dir`` names.

    A local session without that setting gets a temporary folder of its own;
    a cluster session without it is refused, because a machine-local folder
    would be lost with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        context = spark.sparkContext
        root = context.getCheckpointDir()
        if root is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
            root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/lexmill-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the scratch folder and read it back.

    Used where a result is read more than once and has to be the same each
    time.  Later readers only scan the columns they need, and a lost executor
    costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _passing:
        _passing[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# The tables that the steps of each open :func:`store_result` have left.
_passing: list[list[str]] = []


def store_result(spark: SparkSession, steps: Callable[[], DataFrame], label: str) -> DataFrame:
    """:func:`materialize` what ``steps`` gives, and delete the tables they materialised.

    Only the result may be read afterwards.  The steps' shuffle files go with their plans.
    """
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _passing.append([])
    try:
        df = steps()
        df.write.parquet(path)
        schema = df.schema
        del df
    finally:
        for left in _passing.pop():
            _delete(spark, left)
    spark.sparkContext._jvm.System.gc()  # Spark drops the shuffle files of plans that nothing refers to
    if _passing:
        _passing[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def release_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables once its outputs are written."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
