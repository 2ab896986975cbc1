import os
import sys
import warnings

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tabletrail.session import local_session

    warnings.filterwarnings("ignore")
    session = local_session("tabletrail-tests", cores=os.cpu_count() or 4, **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from tabletrail.plans import release_scratch

    release_scratch(session)
    session.stop()
