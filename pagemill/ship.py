"""Makes the package importable in Python workers that don't share its path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends a zip of the package to the workers, once a session, unless they
    find it by the working directory or PYTHONPATH."""
    here = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _done or str(ROOT) in here:
        return
    path = Path(tempfile.mkdtemp(prefix="pagemill-ship-")) / "pagemill.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in [*ROOT.glob("pagemill/**/*.py"), *ROOT.glob("pagemill/data/*"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _done.add(app)
