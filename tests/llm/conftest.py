import pytest

from codestrata.session import build_local


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_local("codestrata-llm-tests", cpus="4", shuffle_partitions=4)
    yield s
