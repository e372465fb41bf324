"""Session helpers: a local session for tests, the shared folder, cutting lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shelfspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's (``spark.checkpoint.dir``).

    Only a session of one machine (``local``, as in tests) may have none configured; it gets a temporary folder. On a
    cluster a folder of one machine would be of no use to the others, so there it is an error.
    """
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="shelfspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        given = f"file://{own}"
    context.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: the lineage ends here and survives lost executors.

    Spark deletes the files when nothing refers to them any more if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, as ``local_session`` does and clusters should.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
