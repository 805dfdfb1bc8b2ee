"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
# Seconds of materialising after which the driver's garbage is collected, and those since then.
COLLECT_S = 3.0
_WORKED = [0.0]


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once for each application, so that Python workers find it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="linkloom-code-")  # the driver's copy, which executors fetch
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(root, f"{folder}/code/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", f"{folder}/code"))
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data directory."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least a task for each core: a small table in one file is dealt out, a large one stays as it is read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Where neither that setting nor a
    programmatic one exists, a local session gets a temporary folder and a cluster an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir")
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="linkloom-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    Shuffles of dropped lineages and checkpoints that nothing reads any more stay on disk until the driver's JVM collects its
    garbage, which a large heap puts off; so it is asked to after every few seconds of work.
    """
    checkpoint_dir(df.sparkSession)
    began = time.monotonic()
    out = df.checkpoint(eager=True)
    _WORKED[0] += time.monotonic() - began
    if _WORKED[0] > COLLECT_S:
        _WORKED[0] = 0.0
        gc.collect()
        df.sparkSession._jvm.System.gc()
    return out
