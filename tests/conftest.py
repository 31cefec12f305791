import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

@pytest.fixture(scope="session")
def spark():
    from footfall.session import build_session

    session = build_session(
        "local[8]", "footfall-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fixtures(spark):
    from compare import SMALL
    from footfall.sources.fixtures import Fixtures

    return Fixtures(spark, SMALL)
