"""Sessions, and sending this package to executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def local(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine with the settings that the queries expect (UTC, adaptive plans)."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="winnow-")
    path = os.path.join(folder, "winnow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    context.addPyFile(path)
