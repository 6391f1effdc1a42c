"""Makes the package importable in Python workers that don't share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package once per application, unless PYTHONPATH already leads workers to it."""
    context = spark.sparkContext
    path = str(context._jvm.System.getenv("PYTHONPATH") or "")
    if str(ROOT) in path.split(os.pathsep) or context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp()) / "verbaloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in [*(ROOT / "verbaloom").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
