"""This package for the executors' Python workers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application, once; workers import it where they don't have it installed."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or not root.is_dir():
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    to = Path(tempfile.mkdtemp(prefix="ship-")) / "quillspark_library.zip"
    to.write_bytes(body.getvalue())
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)
