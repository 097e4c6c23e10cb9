"""Getting this package to the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for an application.

    Workers import the functions that run in them by name, wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tesserae-")  # of the driver alone, which serves the file from there
    atexit.register(shutil.rmtree, folder, True)
    out = os.path.join(folder, "tesserae.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(at, n)
                    z.write(path, os.path.join("tesserae", os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)
