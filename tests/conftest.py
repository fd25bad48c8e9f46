import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from panelwright.testing import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(name="panelwright-tests")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF
