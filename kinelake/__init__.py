"""Spark-native processing of episodic trajectory data and of training corpora."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch, so that a batch of very long texts or of pictures fits a Python worker; the same for every operator.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
_RECORDS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, on whatever machine they run: once for each Spark context.

    Spark sends the file to executors itself; its place on the driver is only where it is read from.
    """
    sc, folder = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_kinelake", False) or not folder.is_dir():
        return
    name = Path(tempfile.mkdtemp(prefix="kinelake-")) / "kinelake.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(folder.rglob("*.py")):
            z.write(p, p.relative_to(folder.parent))
    sc.addPyFile(str(name))
    sc._kinelake = True


def small_batches(spark: SparkSession) -> None:
    """Bounds what Spark hands to a Python worker at once, and sees that it can import this package.

    A smaller bound that the session has already stays. Plans are lazy, so the bound is one for all operators.
    """
    ship(spark)
    for name, most in ((_RECORDS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        own = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
        if not 0 < own <= most:
            spark.conf.set(name, str(most))
