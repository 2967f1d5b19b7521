import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracewright.session import remove_scratch, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    remove_scratch()
    s.stop()


@pytest.fixture(scope="session")
def make_cases(spark):
    def make(*traces):
        rows = [(f"t{i}", len(t), list(t)) for i, t in enumerate(traces)]
        return spark.createDataFrame(rows, "case_id string, n int, trace array<string>")

    return make
