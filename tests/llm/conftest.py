import pytest

from casefuse.llm.common import importable


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    return importable(spark)
