"""Every registered query with SQL of its own against DuckDB, on the smallest tables."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from zedweave.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else int(v) if isinstance(v, Decimal) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module", autouse=True)
def generated_code(spark):
    """Plans as they run in production: the other tests turn code generation off to save time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    r = duck.execute(ORACLE_SQL[name])
    assert got == rows([d[0] for d in r.description], r.fetchall())
    assert got[1]


def test_streams_of_folders(spark, tmp_path):
    """A table may be a file or a folder of part files."""
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    of = lambda folder: sorted(map(tuple, QUERIES["streamed_counts"](spark, folder).collect()))
    assert of(str(tmp_path)) == of(SF) != []


def test_no_folder_on_a_cluster():
    from types import SimpleNamespace

    from zedweave.plans.store import shared_folder

    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getConf=lambda: {}))
    assert shared_folder(session("local[3]")).startswith("file:///")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
