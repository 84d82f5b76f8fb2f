"""Compare result column types of every query with its oracle SQL (DuckDB vs Spark)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from pulse import registry  # noqa: E402
from pulse.session import get_spark  # noqa: E402
from pulse.sources.tables import DRIVER_TABLES  # noqa: E402

MAP = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
       "DATE": "date", "FLOAT": "float", "SMALLINT": "smallint"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark("local[4]", shuffle_partitions=4)
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t + '.parquet')}')")
    q, o = registry.queries(), registry.oracle_sql()
    bad = 0
    for name, sql in o.items():
        d = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        s = {f.name: f.dataType.simpleString() for f in q[name](spark, sf).schema.fields}
        for col, dt in d.items():
            want = MAP.get(dt, dt)
            if s.get(col) != want:
                bad += 1
                print(f"{name}.{col}: duckdb={dt} spark={s.get(col)}")
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
