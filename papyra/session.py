"""Session helpers shared by every part of the package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch. Whole documents travel in these batches, so the row
#: count is kept low: a thousand documents of 100 kB are 100 MB, not a gigabyte.
ARROW_ROWS = 1000


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks, with the settings the operators assume."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("papyra")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and bound the Arrow batches of the session.

    Only Spark's untouched default of 10,000 rows a batch is replaced; a value that the
    user has set stays. The package travels as one zip through Spark's own file service,
    so executors need neither a shared folder nor an installed copy.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_papyra_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="papyra-"))  # executors fetch from it later
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "papyra_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._papyra_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one in ``spark.checkpoint.dir``.

    A folder of our own, removed when the session's JVM ends, is set only where none is named and the
    session is a local one, as in tests; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "papyra-checkpoints"))
        if not named:
            remove_at_exit(spark, sc.getCheckpointDir())
    return sc.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate data."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the session's JVM ends."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
