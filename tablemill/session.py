"""Sessions: sending the package to executors, wherever their working folder is."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable on every executor, once an application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="tablemill-")) / "tablemill.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, os.path.join(top.name, p.relative_to(top)))
    spark.sparkContext.addPyFile(str(out))
    _sent.add(app)
