import pytest

from talkloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "talkloom-tests",
        **{
            "spark.master": "local[4]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Apply a column function to a list of strings."""
    from pyspark.sql import functions as F

    def run(function, values):
        rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
