from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gaugewise.session import BUILDER_CONF, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false").config("spark.driver.memory", "8g").config(
        "spark.ui.showConsoleProgress", "false").config(
        "spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    for k, v in BUILDER_CONF.items():
        builder = builder.config(k, v)
    session = tune(builder.getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
