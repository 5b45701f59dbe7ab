import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
# worker processes import the package too, whatever folder they start in
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], *filter(None, [os.environ.get("PYTHONPATH")])])

from parcelscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "parcelscope-tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                                         "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
