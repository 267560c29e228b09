import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from stemmata.session import ship

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def same(spark_df, sql_df) -> None:
    """Equal columns and rows, in any order."""
    a = spark_df.toPandas()
    cols = sorted(a.columns)
    assert cols == sorted(sql_df.columns)
    flat = lambda d: d[cols].astype(str).replace({"nan": "None", "<NA>": "None"}).apply(lambda s: s.str.replace(r"\.0$", "", regex=True)).sort_values(cols).reset_index(drop=True)
    a, b = flat(a), flat(sql_df)
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head()


@pytest.fixture(scope="session")
def equal():
    return same
