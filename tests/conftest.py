from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerlight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def day():
    return lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="session")
def series(spark, day):
    """Daily rows of one series per list of costs; ``None`` leaves the day out."""

    def build(costs: dict[str, list[float | None]]):
        rows = [
            (day(i), "AWS", service, "data", "prod", float(c), float(c), 1)
            for service, values in costs.items() for i, c in enumerate(values) if c is not None
        ]
        return spark.createDataFrame(
            rows,
            "date date, provider string, service_category string, team string, environment string, "
            "total_cost double, avg_cost double, record_count long",
        )

    return build
