import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from callglass import session  # noqa: E402
from callglass.operators import ingest  # noqa: E402
from callglass.sources.given import Given  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", 4, **{"spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def given(spark):
    return Given(spark, "/root/testdata/sf0.001")


ID = "00000000-0000-4000-8000-%012d"
CALL = {
    "id": ID % 1,
    "provider": "mock",
    "model": "mock-1",
    "status": "success",
    "started_at": "2024-01-01T00:00:00Z",
    "completed_at": "2024-01-01T00:00:00.050Z",
}


def event(drop=(), **changes):
    body = {**CALL, **changes}
    return {k: v for k, v in body.items() if k not in drop}


def deliveries(spark, events):
    rows = [(i, e if isinstance(e, str) or e is None else json.dumps(e)) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "delivery_id long, data string")


def checked(spark, events):
    return ingest.check(deliveries(spark, events))
