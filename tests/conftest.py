import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.harness import DATA, duck, session  # noqa: E402

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="session")
def folder():
    return FOLDER
