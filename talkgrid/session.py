"""Session helpers: a local session for tests, and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: its sources go out once per application with addPyFile."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        folder = tempfile.mkdtemp(prefix="spark-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "talkgrid_src.zip")
        Path(path).write_bytes(data.getvalue())
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


def local(cores: int = 8, partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
