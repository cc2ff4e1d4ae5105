import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnout.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "turnout-tests", "6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from checks.catalog import Inputs

    return Inputs.of(spark, SF)
