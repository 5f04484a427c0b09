"""Sends this package to the executors once for each application."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app not in _done:
        _done.add(app)
        folder = tempfile.mkdtemp()  # the driver serves the file from here to its executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        to = os.path.join(folder, f"engine_{app.replace('-', '_')}.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, str(p.relative_to(PACKAGE.parent)))
        spark.sparkContext.addPyFile(to)
