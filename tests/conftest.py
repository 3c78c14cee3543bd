import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from domgrove.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", 4)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def make_pages(spark):
    def make(htmls, url="https://site.example/dir/page.html?x=1#f"):
        return spark.createDataFrame(
            [(i, url, html) for i, html in enumerate(htmls)],
            "page_id long, url string, html string")
    return make
