"""Session helpers: local sessions for tests and benches, code shipping for clusters."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", app: str = "quern", **conf: str) -> SparkSession:
    """A local session as tests and benches use it; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    Workers don't share the driver's import path, not even those of a local
    master.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for path in sorted(_PACKAGE.rglob("*.py")):
            z.write(path, str(path.relative_to(_PACKAGE.parent)))
    target = Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
    target.write_bytes(buffer.getvalue())
    sc.addPyFile(str(target))
    sc._quern_shipped = True
