"""The fixture of the training-data tests (a second conftest would hide the first one's names)."""

import pytest


@pytest.fixture(scope="session")
def workers(spark):
    """A session whose Python workers can import the package."""
    from crease.llm.common import ship

    ship(spark)
    return spark
