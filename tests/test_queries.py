"""Each registered query against its SQL in DuckDB, and the number and text rules on small rows."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docrecon import plans  # noqa: F401
from docrecon.functions import scalars
from docrecon.operators.core import reconcile
from docrecon.operators.history import lookup_importer
from docrecon.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object).where(df[cols].notna(), None)
    same = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return cols, sorted(repr(tuple(map(same, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(duck.sql(SQL[name]).df())
    else:
        assert len(got)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


def test_numbers_and_dates(spark):
    assert one(spark, "17 100,00", scalars.parse_amount) == 17100.0
    assert one(spark, "17100.000", scalars.parse_amount) == 17100.0
    assert one(spark, "1.2.3", scalars.parse_amount) is None
    assert one(spark, "EUR 5", scalars.parse_amount) is None
    assert one(spark, "2.5", scalars.parse_int_amount) == 2
    assert one(spark, "EUR -12,5", scalars.amount_eu) == 12.5
    assert one(spark, "1.234.50", scalars.clean_amount) == "1234.50"
    assert one(spark, "05/05/2026", scalars.normalize_date) == "05-05-2026"
    assert one(spark, "31/02/2026", scalars.normalize_date) is None
    assert one(spark, "05-05-3026", scalars.fix_year_typo) == "05-05-2026"
    assert one(spark, "Éléphant", scalars.fold_text) == "ELEPHANT"
    assert one(spark, " ..a b-", lambda c: scalars.path_segment(c, "x")) == "a_b"


def test_reconcile_cases(spark):
    inv = spark.createDataFrame([(1, 2600.0, "USD", 11), (2, 17100.0, "EUR", 12), (3, 100.0, "EUR", 13), (4, None, "EUR", 14), (5, 5.0, "EUR", None)], "id int, net_pay double, devise string, dum_id int")
    inv = inv.selectExpr("*", "cast(null as double) montant_ttc", "cast(null as int) nombre_colis", "cast(null as double) poids_net", "cast(null as string) mode_livraison")
    dum = spark.createDataFrame([(11, 2600.0, "USD"), (12, 2600.0, "USD"), (13, 100.0, "USD"), (14, 1.0, "EUR")], "dum_id int, pfn double, dum_devise string")
    dum = dum.selectExpr("*", "'1' dum_numero", "cast(null as int) dum_colis", "cast(null as double) dum_poids", "cast(null as string) dum_mode")
    got = {r["id"]: r for r in reconcile(inv, dum).collect()}
    assert (got[1]["status"], got[1]["gap"]) == ("ok", 0.0)
    assert (got[2]["status"], got[2]["gap"]) == ("error", 14500.0)
    assert got[3]["status"] == "warning" and "currency_mismatch" in got[3]["codes"]
    assert got[4]["codes"] == ["invoice_amount_missing"] and got[5]["codes"] == ["dum_pfn_missing"]


def test_importer_codes_are_whole(spark):
    """A client's number of five digits is not the client of its first four."""
    assert [one(spark, c, scalars.importer_code) for c in ("cl 1200", "CL12000", "CL120000", "12000", "client CL12, x")] == ["CL1200", "CL12000", "CL120000", "12000", "CL12"]
    entries = spark.createDataFrame([("cl 1200", "Atelier Nord")], "code string, company string")
    docs = spark.createDataFrame([(1, "CL12000"), (2, "CL1200"), (3, "1200"), (4, "120000")], "id int, code string")
    assert sorted(map(tuple, lookup_importer(docs, entries).select("id", "importer_name").collect())) == [(1, None), (2, "ATELIER NORD"), (3, "ATELIER NORD"), (4, None)]
