import os
import sys
from pathlib import Path

import pytest
from hypothesis import settings
from pyspark.sql import SparkSession

settings.register_profile("no_deadline", deadline=None)
settings.load_profile("no_deadline")

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
#: Python workers import the package, and what tests define.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, f"{ROOT}/tests", f"{ROOT}/tests/llm", os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
