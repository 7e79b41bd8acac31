import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="linkweave-tests-")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def column(spark):
    """Evaluate a Column over a list of strings (as ``x``) and return the values."""
    def run(values, expression):
        rows = spark.createDataFrame(
            [(i, v) for i, v in enumerate(values)], "i int, x string"
        ).select("i", expression.alias("y"))
        return [r["y"] for r in sorted(rows.collect(), key=lambda r: r["i"])]

    return run
