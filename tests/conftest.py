import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pulse.session import get_spark
    s = get_spark("local[4]", app="pulse-tests", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from pulse.sources.tables import DRIVER_TABLES

    made = []

    def make(sf):
        con = duckdb.connect()
        for t in DRIVER_TABLES:
            p = os.path.join(sf, f"{t}.parquet")
            if os.path.exists(p):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
        made.append(con)
        return con
    yield make
    for con in made:
        con.close()
