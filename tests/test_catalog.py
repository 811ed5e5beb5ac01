"""Every query with oracle SQL gives DuckDB's rows; the others run."""

import math
from decimal import Decimal

import duckdb
import pytest

from chronolake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in got.fetchall()), key=repr)
    assert rows == expected


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).columns == ["id", "place", "score"]


def same_as_sql(spark, folder, name):
    """The query's rows and its SQL's over the tables of a folder, whole digits compared."""
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in got.description]
    return sorted(map(repr, (tuple(r[c] for c in names) for r in catalog.queries()[name](spark, str(folder)).collect()))) == sorted(map(repr, got.fetchall()))


def parts(folder):
    duckdb.execute(f"COPY (SELECT i AS p_partkey, 'Brand#' || (i % 25) AS p_brand, 'blue rod' AS p_name, 'SMALL' AS p_type, (i // 100 % 50 + 1)::INTEGER AS p_size FROM range(5000) r(i)) TO '{folder}/part.parquet'")
    return folder


def test_memory_nodes_round_as_the_sql(spark, tmp_path):
    assert same_as_sql(spark, parts(tmp_path), "g15_memory_nodes")


def test_memory_edges_round_as_the_sql(spark, tmp_path):
    assert same_as_sql(spark, parts(tmp_path), "g15_memory_edges")


def test_concentration_without_spans_is_the_sqls(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT * FROM (VALUES (11, 'Erö.'), (22, NULL), (33, 'We decided to fix the blocker.'), (5, 'x')) t(doc_id, text)) TO '{tmp_path}/documents.parquet'")
    assert same_as_sql(spark, tmp_path, "t12_concentration")


def test_concentration_is_of_all_spans(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT * FROM (SELECT 5 AS doc_id, string_agg('We met at place ' || i || ' today.', ' ' ORDER BY i) || ' Therefore We Decided Shipping Must Review Fix Next.' AS text FROM range(150) r(i))) TO '{tmp_path}/documents.parquet'")
    assert same_as_sql(spark, tmp_path, "t12_concentration")
    share = catalog.queries()["t12_concentration"](spark, str(tmp_path)).first().concentration
    assert 0.02 < share < 0.035  # three of some 150 spans; of the first 64 it was over 0.045


def test_difference_takes_every_order(spark, tmp_path):
    duckdb.execute(f"COPY (SELECT i AS c_custkey FROM range(9) r(i)) TO '{tmp_path}/customer.parquet'")
    duckdb.execute(f"COPY (SELECT i + 1 AS o_orderkey, i AS o_custkey FROM range(5) r(i)) TO '{tmp_path}/orders.parquet'")
    assert sorted(r[0] for r in catalog.queries()["u05_difference"](spark, str(tmp_path)).collect()) == [5, 6, 7, 8]
    assert same_as_sql(spark, tmp_path, "u05_difference")
