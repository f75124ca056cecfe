"""Session settings for tests, benchmarks and local use.

Library code never calls this: every operator works on the session that owns
the DataFrame it is given.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # no stack trace per Column call: plans with hundreds of columns build in half the time
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "quotegrid") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Shared checkpoint folder named by the cluster.

    ``fallback`` is applied only when the session names none (tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    target = configured or fallback
    if target:
        spark.sparkContext.setCheckpointDir(target)
    return target


ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Prepares a session for Python stages: smaller batches, and this package on the executors (once per context).

    Rows may hold whole texts, so a batch of Spark's default size can take many megabytes in the JVM, in Arrow and in
    Python at once; a session that sets its own size keeps it. The archive is made in a temporary folder of the driver and
    served by Spark; executors fetch it.
    """
    context = spark.sparkContext
    if not context.getConf().contains(ROWS_PER_BATCH) and spark.conf.get(ROWS_PER_BATCH) == "10000":
        spark.conf.set(ROWS_PER_BATCH, "1000")
    if getattr(context, "_quotegrid_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="quotegrid-ship-"), "quotegrid_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "quotegrid")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(archive)
    context._quotegrid_shipped = True
