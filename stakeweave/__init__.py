"""Ownership-graph analytics on Spark: DataFrame in, DataFrame out."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of ``spark``, once a session.

    Workers that find the package on their own path keep using that copy.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="stakeweave-")) / "stakeweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
