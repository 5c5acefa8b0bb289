import pytest

from furrow.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "furrow-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
