import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from gleaner.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="gleaner-tests")
    yield s


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The hand-made edge tables, as Spark tables and as parquet for DuckDB."""
    from tests.fixtures import edge_tables
    root = str(tmp_path_factory.mktemp("edge"))
    tables = edge_tables(spark)
    paths = {}
    for name, df in tables.by_name().items():
        paths[name] = f"{root}/{name}"
        df.coalesce(1).write.mode("overwrite").parquet(paths[name])
    return tables, paths
