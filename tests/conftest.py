import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from accesslens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "accesslens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pipeline(spark):
    from accesslens.plans.pipeline import Pipeline

    from cross_check import SMALL

    return Pipeline.of(spark, SMALL)
