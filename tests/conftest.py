import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession
    shared = tmp_path_factory.mktemp("checkpoints")
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", str(shared))
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def grid(spark):
    """Turn {sample: 2-D list} into pixels (sample_id, y, x, <name>)."""
    def make(arrays, name="gt"):
        rows = [(s, y, x, int(v)) for s, a in arrays.items() for y, line in enumerate(a) for x, v in enumerate(line)]
        return spark.createDataFrame(rows, f"sample_id int, y int, x int, {name} int")
    return make


def to_dict(df, value):
    return {(r["sample_id"], r["y"], r["x"]): r[value] for r in df.collect()}
