import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from sectionflow import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def rows(df, *order):
    """Rows as plain tuples, sorted by the named columns."""
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="session")
def random_stack(spark):
    """40 sections of 10 x 7 pixels with one pixel in seven missing."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 7, 10))
    values = np.stack([base[z : z + 6].mean(axis=0) for z in range(40)])
    values[rng.random(values.shape) < 1 / 7] = np.nan
    data = [
        (z, x, y, None if np.isnan(values[z, y, x]) else float(values[z, y, x]))
        for z in range(40)
        for y in range(7)
        for x in range(10)
    ]
    df = spark.createDataFrame(data, "z bigint, x bigint, y bigint, v double").cache()
    return df, values
