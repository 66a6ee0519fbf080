"""Making the package importable in Python workers, and bounds on what queries hold."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Unless the application says otherwise: rows of long texts or sets go to Python workers a few MB at a time, and a query's
#: shuffles go from the disks when it has ended.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application; Python workers import it from there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="regionaudit-ship-")) / "regionaudit.zip"
        with zipfile.ZipFile(at, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, f"{root.name}/{file.relative_to(root)}")
        spark.sparkContext.addPyFile(str(at))
        for key, value in SETTINGS.items():
            if not spark.sparkContext.getConf().contains(key):
                spark.conf.set(key, value)
        _shipped.add(app)
    return spark
