"""The package on executors that do not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_delivered: set[str] = set()


def deliver(spark: SparkSession) -> None:
    """Send the package to all Python workers of the application, once."""
    app = spark.sparkContext.applicationId
    if app in _delivered:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    out.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _delivered.add(app)
