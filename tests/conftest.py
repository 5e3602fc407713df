import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from maskwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Texts by path as a corpus."""
    from maskwright.sources.corpus import from_table

    def make(texts: dict[str, str]):
        return from_table(spark.createDataFrame(list(texts.items()), "path string, text string"), "path", "text")

    return make


@pytest.fixture(scope="session")
def lines(spark):
    """(path, line) pairs as numbered lines."""

    def make(pairs):
        rows = [(p, i, line) for i, (p, line) in enumerate(pairs)]
        return spark.createDataFrame(rows, "path string, line_no int, line string")

    return make


@pytest.fixture(scope="session")
def scanned():
    """(new text, findings) per row of a result table, in order of a column."""

    def collect(df, order="line_no"):
        return [(r.result.out, r.result.hits) for r in df.orderBy(order).collect()]

    return collect
