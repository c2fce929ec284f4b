import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.local.dir": str(folder), "spark.sql.warehouse.dir": f"{folder}/warehouse"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if hasattr(value, "isoformat") else value


def rows_of(df, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def duckdb_rows(sql, sf_dir, columns):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert set(columns) <= set(names)
    return sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
