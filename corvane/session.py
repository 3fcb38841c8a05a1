"""What a session needs before workers can run this package's functions."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from corvane.operators.durable import shared_folder

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the workers, once per application, so that they needn't have it installed.

    The archive lies in the shared folder; where that is no mounted one, the
    workers are taken to have the package.
    """
    application = spark.sparkContext.applicationId
    base = shared_folder(spark)
    if application in _SHIPPED or ("://" in base and not base.startswith("file://")):
        return
    _SHIPPED.add(application)
    root = Path(__file__).parent
    archive = Path(base.removeprefix("file://")) / f"corvane-{application}.zip"
    archive.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
