import os

import pytest


@pytest.fixture(scope="session")
def on_workers(spark):
    """Python workers find the package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment["PYTHONPATH"] = root
    return spark
