"""Sessions, and the package on the executors' path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def build_session(app: str = "loamstack", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; ``master`` is left to spark-submit where it is not given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=defaults | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Puts the package on the Python workers' path, once per context, unless PYTHONPATH has it there already."""
    context = spark.sparkContext
    if str(ROOT.parent) in map(os.path.realpath, filter(None, os.environ.get("PYTHONPATH", "").split(":"))) or getattr(context, "_loamstack_shipped", False):
        return spark
    target = Path(tempfile.mkdtemp(prefix="loamstack-")) / "loamstack.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(ROOT.rglob("*.py")):
            z.write(file, Path("loamstack") / file.relative_to(ROOT))
    context.addPyFile(str(target))
    context._loamstack_shipped = True
    return spark
