"""Every registered query of the llm subpackage against its SQL, or at least to its end."""

import pytest

from skeinworks.llm.queries import ORACLE, QUERIES
from tests.support import DATA, database, same


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    if name in ORACLE:
        same(spark, QUERIES[name], ORACLE[name], db)
    else:
        QUERIES[name](spark, DATA).collect()


def test_not_imported_elsewhere():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[2] / "skeinworks"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(from|import) skeinworks\.llm", p.read_text()), p
