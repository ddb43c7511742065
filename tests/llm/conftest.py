import os

import pytest

from parcelsight.llm import shared


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """The folder that a cluster would name; sessions of tests name none."""
    return shared.shared_root(spark)


@pytest.fixture(scope="session")
def corpus(folder):
    return os.path.join(folder, "documents.parquet")
