import os

import pytest

from feedloom.session import session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TZ", "UTC")
    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
