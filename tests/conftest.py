import pytest

from tests.trees import write_tree
from wayweft.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tree(tmp_path_factory):
    return write_tree(tmp_path_factory.mktemp("tree"))


@pytest.fixture(scope="session")
def snapshot(spark, tree):
    from wayweft.plans.snapshot import Snapshot
    from wayweft.sources.tree import files_from_tree

    return Snapshot.of_files(files_from_tree(spark, str(tree), include_hidden=True))


@pytest.fixture(scope="session")
def engine(spark):
    from wayweft.engine import Engine

    return Engine(spark)
