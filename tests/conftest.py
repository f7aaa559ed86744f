import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sourceassay.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def code(spark):
    """``code({'a.js': text, ...})`` -> decoded files."""
    from sourceassay import fixed_values as fv

    def build(files, project="p"):
        rows = [(project, path, fv.RULE_EXTENSIONS["." + path.rsplit(".", 1)[1]], text)
                for path, text in files.items()]
        return spark.createDataFrame(rows, "project string, path string, language string, content string")
    return build
