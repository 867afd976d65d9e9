"""Make this package importable in Python workers that don't run beside the driver."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Send the package to the executors, once for each application; nothing if PYTHONPATH has it."""
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(":") or sc.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(), "brigade_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "brigade")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
        if os.path.exists(top := os.path.join(root, "corpus_pipeline.py")):
            z.write(top, "corpus_pipeline.py")
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
