import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Rows of a query and of its SQL, both as sorted lists of dicts' reprs."""
    import duckdb

    def run(spark, query, sql, sf_dir):
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            files = str(p) if p.is_file() else f"{p}/*.parquet"
            con.execute(f"create view {p.stem} as select * from read_parquet('{files}')")
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted(repr([r[n] for n in names]) for r in df.collect())
        found = con.execute(sql)
        at = [[c[0] for c in found.description].index(n) for n in names]
        return got, sorted(repr([r[i] for i in at]) for r in found.fetchall())

    return run
