import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[2]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def rows_of(df):
    """Rows as sorted tuples in order of column name, floats rounded."""
    names = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(sql, tables):
    """Rows of DuckDB SQL over {name: parquet path or pandas frame}, as rows_of gives them."""
    import duckdb

    con = duckdb.connect()
    for name, source in tables.items():
        if isinstance(source, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
        else:
            con.register(name, source)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
