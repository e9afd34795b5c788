from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.log.level": "ERROR"}
    session = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").appName("tests").config(map=conf).getOrCreate()
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(schema, [tuple, ...]) -> DataFrame"""
    return lambda schema, data: spark.createDataFrame(data, schema)
