import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from tallyframe.session import local_session

    session = local_session("*", 4)
    session.sparkContext.setLogLevel("ERROR")
    # The frames are tiny: compiling plans would take longer than running them.
    session.conf.set("spark.sql.codegen.wholeStage", False)
    yield session
    session.stop()
