import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wardline import tune  # noqa: E402

IN_TIME = datetime(2150, 1, 1)


def at(hours: float) -> datetime:
    """A time the given number of hours after the in-time of the fixtures."""
    return IN_TIME + timedelta(microseconds=round(hours * 3_600_000_000))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("wardline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def cohort(spark):
    """One stay (1) of subject 10 at the in-time, and two stays of subject 20."""
    return spark.createDataFrame(
        [(10, 1, IN_TIME), (20, 2, IN_TIME), (20, 3, at(120))],
        "subject_id long, stay_id long, icu_intime timestamp_ntz",
    )
