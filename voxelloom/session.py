"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("voxelloom").config("spark.driver.memory", memory)
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: by path on one machine, else as a zip file."""
    sc = spark.sparkContext
    if getattr(sc, "_voxelloom_shipped", False):
        return spark
    if sc.master.startswith("local"):
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(PACKAGE.parent), *filter(None, paths)])
    else:
        target = Path(tempfile.mkdtemp()) / "voxelloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in PACKAGE.rglob("*.py"):
                z.write(p, p.relative_to(PACKAGE.parent))
        sc.addPyFile(str(target))
    sc._voxelloom_shipped = True
    return spark
