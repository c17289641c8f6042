import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def large(spark):
    """Force the plans that large inputs take, with tiny chunks."""
    values = {"smallBytes": "0", "hotRows": "20", "chunkRows": "13"}
    for k, v in values.items():
        spark.conf.set(f"spark.creditspark.{k}", v)
    yield
    for k in values:
        spark.conf.unset(f"spark.creditspark.{k}")


@pytest.fixture
def small(spark):
    """Force the short plans."""
    spark.conf.set("spark.creditspark.smallBytes", str(2**62))
    yield
    spark.conf.unset("spark.creditspark.smallBytes")
