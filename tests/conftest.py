import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config(
            "spark.checkpoint.dir",
            str(tmp_path_factory.mktemp("shared")),
        ).getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return c


def same_rows(df, table):
    """Whether a DataFrame and a DuckDB result hold the same rows, whatever their order."""
    a, b = df.toPandas(), table.df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    told = lambda x: sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))
    assert told(a) == told(b)
