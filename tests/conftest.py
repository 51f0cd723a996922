import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """``{pkg: {path: content}}`` to a package-file frame; every package has version 1.0.0."""

    def make(packages):
        rows = [
            (pkg, "1.0.0", path, content)
            for pkg, files in packages.items()
            for path, content in files.items()
        ]
        return spark.createDataFrame(
            rows, "pkg string, version string, path string, content string"
        )

    return make


@pytest.fixture(scope="session")
def by_package():
    def collect(df):
        found = {}
        for row in df.collect():
            found.setdefault(row["pkg"], []).append(row)
        return found

    return collect
