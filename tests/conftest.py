import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("weblode-tests").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def page(spark):
    """Build a nodes table out of (url, html) pairs."""
    from weblode.operators import dom

    def build(*pages):
        rows = [(i, url, url, 200, html) for i, (url, html) in enumerate(pages)]
        df = spark.createDataFrame(rows, "page_id long, url string, requested_url string, status int, html string")
        return dom.with_nodes(df)

    return build
