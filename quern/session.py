"""What a session needs before workers can run this package's functions."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Rows read, and rows and bytes of text that reach a Python worker, together; two workers and a JVM share an executor's
#: memory, and texts are long rows.
BATCH = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session: they need not have it installed or share the driver's folder.

    Batches are made smaller where the session has Spark's defaults.
    """
    for key, (default, small) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)
    context = spark.sparkContext
    if not getattr(context, "_quern_shipped", False):
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
        context._quern_shipped = True
    return spark
