"""Sessions, and getting this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def importable(spark: SparkSession) -> bool:
    """Whether workers find the package by this process' working folder or PYTHONPATH, as only those on its own machine do."""
    if not spark.sparkContext.master.startswith("local"):
        return False
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and Path(p).resolve() == ROOT for p in paths)


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once a session, unless they find it by themselves.

    On a cluster, ``spark-submit --py-files`` does the same ahead of time.
    """
    if importable(spark) or getattr(spark.sparkContext, "_framelake_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-framelake-", dir="/tmp")) / "framelake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / "framelake").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._framelake_shipped = True
