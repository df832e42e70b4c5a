import pytest

from tests.spark import session


@pytest.fixture(scope="session")
def spark():
    from assayframe.session import tune

    return tune(session())


@pytest.fixture
def tables(spark):
    """Empty notebook; ``fill(name, rows)`` adds rows given as dicts."""
    from assayframe.contract import ROW_KEY, TABLES

    class Notebook(dict):
        def fill(self, name, rows):
            cols = TABLES[name].columns
            data = [(f"{i:06d}", *[str(r.get(c, "")) for c in cols]) for i, r in enumerate(rows)]
            self[name] = spark.createDataFrame(data, TABLES[name].schema())
            return self

    nb = Notebook()
    for name in TABLES:
        nb.fill(name, [])
    return nb
