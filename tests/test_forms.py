"""Whole forms and what must be found in them: declarations with and without cells of templates, articles, invoices, guardrails."""

import pytest
from pyspark.sql import functions as F

from docrecon.functions.scalars import normalize_noise
from docrecon.operators import extraction as E
from docrecon.operators import field_rules as R
from docrecon.operators import quality as Q
from docrecon.operators.declaration import parse_declarations

KEY = "D505ABC1D"
ZONES = {"tpl_importateur_nom": "ATELIERS REUNIS NORD", "tpl_numero_declaration": "123456", "tpl_date_declaration": "05/05/2026", "tpl_type_declaration": "EA", "tpl_itineraire": "SFAX-RADES", "tpl_bureau_douane": "br - Sfax", "tpl_cle_authentification": KEY, "tpl_pays_achat": "US U.S.A", "tpl_block_1": "left out"}


def part(spark, text, f):
    return E.fields(spark.createDataFrame([(text,)], "text string"), f).drop("text").first().asDict()


def parsed(spark, *docs):
    rows = parse_declarations(spark.createDataFrame([(i, text, zones) for i, (text, zones) in enumerate(docs)], "id int, text string, zones map<string,string>"))
    return [r.asDict() for r in rows.orderBy("id").collect()]


def told(got, *names):
    return tuple(got[n] for n in names)


def test_header_transport_and_amounts(spark):
    got = part(spark, "\n  TYPE DECLARATION IM4 3 120\n  123456 01/02/2026\n", E.header_fields)
    assert told(got, "number", "date", "type", "articles", "packages") == ("123456", "01-02-2026", "IM4", 3, 120)
    got = part(spark, "\n  TN 7 NAVIRE 14/03/2026\n  TN 4 CAMION\n  FOB 2 3\n", E.transport_fields)
    assert told(got, "mode", "national_mode", "terms", "payment", "relation", "arrival") == ("7 - MARITIME", "4 - ROUTIER", "FOB", "2", "3", "14-03-2026")
    assert part(spark, "EUR 1000.000 TAUX 3.250000", E.financial_fields)["total"] == "3250.000"


@pytest.mark.parametrize(("text", "want"), [
    ("VALEUR EN DINARS FOB 58477.725 DOUANE 58477.725 COEF AJUSTEMENT", ("58477.725", "58477.725", None)),
    ("REGIME 56 QCI", (None, None, "56")), ("POIDS NET 57 REGIME 56 FOB 58477.725 DOUANE 58477.725", ("58477.725", "58477.725", "56")),
])
def test_values_of_articles(spark, text, want):
    assert told(part(spark, text, E.article_value_fields), "fob", "customs", "regime") == want


def test_quantities_behind_their_labels(spark):
    line = "1 88073000011 TN 39950.000 CODE QCS 06 QCS 104 PFN 11750.000 POIDS BRUT (KG) 200 POIDS NET (KG) 104"
    assert told(part(spark, line, E.guided_fields), "code_qcs", "qcs", "pfn", "guided_gross", "guided_net") == ("06", "104", "11750.000", "200", "104")
    (row,) = E.articles(spark.createDataFrame([(1, line)], "id int, text string")).collect()
    assert (row["line"], row["hs"], row["country"], row["value"], row["gross"], row["net"]) == (1, "88073000011", "TN", 39950.0, "200", "104")


def test_cells_fill_weak_texts(spark):
    weak, none, null = parsed(spark, ("Texte faible", ZONES), ("Texte faible", None), (None, {"tpl_x": None, "tpl_numero_declaration": " "}))
    assert told(weak, "number", "date", "type", "importer", "office", "route", "auth_key", "purchase") == ("123456", "05-05-2026", "EA", "ATELIERS REUNIS NORD", "BR - SFAX", "SFAX-RADES", KEY, "US USA")
    for empty in (none, null):
        assert not any(told(empty, "number", "date", "type", "importer", "office", "route", "auth_key", "purchase", "articles"))


def test_texts_go_before_cells(spark):
    text = f"123456 01/01/2026\nTYPE DECLARATION EA 1 10\nTN 7 NAVIRE 01/01/2026\nATELIERS REUNIS NORD\nBR - SFAX\n{KEY}\n"
    (got,) = parsed(spark, (text, ZONES | {"tpl_numero_declaration": "999999", "tpl_date_declaration": "02/02/2026", "tpl_pays_achat": "FRANCE"}))
    assert told(got, "number", "date", "type", "importer", "office", "route", "auth_key", "purchase") == ("123456", "01-01-2026", "EA", "ATELIERS REUNIS NORD", "BR - SFAX", "SFAX-RADES", KEY, "FR FRANCE")
    assert got["score"] is not None and got["quality"] in ("HAUT", "MOYEN", "BAS") and got["flags"] is not None


def test_misread_words_are_put_right_before_parsing(spark):
    (got,) = parsed(spark, ("POIDA BRUT 240 PAIDA NET 120\nU5D 12345.678\nD§0§ABC1D", None))
    assert told(got, "gross", "net", "auth_key") == ("240", "120", KEY) and got["financials"]["currency"] == "USD"
    fixed = lambda t: spark.createDataFrame([(t,)], "t string").select(normalize_noise(F.col("t")).alias("t")).first()["t"]
    assert fixed("  L’AVION  `x`\n\n\n\nu5d ") == "L'AVION 'x'\n\nUSD" and fixed("clean") == "clean" and fixed("") == "" and fixed(None) is None


def test_extra_columns_with_the_names_of_results(spark):
    docs = spark.createDataFrame([(1, "123456 01/02/2026", "a", "b", "c")], "id int, text string, header string, route string, articles string")
    got = parse_declarations(docs).first()
    assert (got["number"], got["route"], got["articles"], got["text"]) == ("123456", None, [], "123456 01/02/2026")
    assert parse_declarations(docs.limit(0)).count() == 0


def test_cells_within_a_row_are_those_of_the_table(spark):
    rows = spark.createDataFrame([(1, ZONES | {"tpl_poids_brut": "120 kg", "tpl_exportateur": "Ateliers Réunis Numero 12", "tpl_declarant": "A1"}), (2, None), (3, {}), (4, {"other": "x", "tpl_importateur": " "})], "id int, zones map<string,string>")
    flat = rows.select("id", F.explode(R.zones_within(F.col("zones"))).alias("z")).select("id", F.explode("z.names").alias("field_key"), "z.value")
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, R.zone_fields(rows).collect())) and flat.count() > 9


def test_cell_rows_take_what_they_lack_from_text_rows(spark):
    schema = "doc int, place int, page int, line int, hs string, gross string, net string, pfn string"
    cells = spark.createDataFrame([(1, 1, 1, 1, "88073000011", "200", None, "")], schema)
    texts = spark.createDataFrame([(1, 1, None, 1, "88073000011", "300", "104", "11750.000")], schema)
    (row,) = Q.merge_articles(cells, texts, ["gross", "net", "pfn"]).collect()
    assert (row["page"], row["gross"], row["net"], row["pfn"]) == (1, "200", "104", "11750.000")


INVOICE = """Export Invoice
Number FA2500287
Date 12/11/2025
FOR-COM-12/00/20/02/2019
Delivery / BL2500730

Belling Adress
CL252
ALPHA Systems GmbH & Co. KG
Matricule Fiscal: DE256627297

Reference Designation Qty Unit Price Amount
P211862 E Manufacturing of a storage stand 1,00 16 300,00 € 16 300,00 €
Transport fees 800,00 € 800,00 €

Gross 17 100,00 €
Discount 0,00 €
Amount 17 100,00 €
All Taxes Included 17 100,00 €
NET PAY 17 100,00 €

Package Number 1
PB in Kg 130,00
PN in Kg 57,00

Virement 30 Day(s)
* Incoterme : DAP. Seafreight. Port Rades.
"""


@pytest.mark.parametrize("text", [INVOICE, INVOICE + "\nPB in Kg 130,00\nPN in Kg 57,00\n"])
def test_invoices(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(*[c.alias(k) for k, c in E.invoice_fields(F.col("text")).items()]).first().asDict()
    assert told(got, "number", "date", "currency", "net_pay", "incoterm", "client", "packages", "gross", "net", "tax_id") == ("FA2500287", "12/11/2025", "EUR", 17100.0, "DAP", "CL252", 1, 130.0, 57.0, "DE256627297")
    assert "ALPHA" in got["client_name"] and got["confidence"]["date"] == 0.92


def test_guardrails(spark):
    held = {c: "x" for c in sorted(Q.CRITICAL)}
    docs = spark.createDataFrame([("LOW", [], *held.values()), ("HIGH", [], *held.values()), ("HIGH", ["a"], *held.values())], "registration string, conflicts array<string>, " + ", ".join(f"{c} string" for c in held))
    low, high, torn = Q.review_guardrail(docs).collect()
    assert low["review"] == torn["review"] == list(held) and low["manual_review"] and torn["manual_review"] and not high["manual_review"] and high["review"] == []
    pairs = [("importateur_nom", "DECLARANT CODE 7179"), ("importateur_nom", "ALPHA Systems GmbH"), ("num_repertoire", "ABC12"), ("num_repertoire", "7207"), ("nombre_colis", "1"), ("nombre_colis", "ABC")]
    df = spark.createDataFrame(pairs, "k string, v string").select("*", Q.candidate_score(F.col("k"), F.col("v"), 0.5, F.lit(0.9)).alias("score"), R.coherent(F.col("k"), F.col("v")).alias("coherent"))
    score, fits = ({(r["k"], r["v"]): r[c] for r in df.collect()} for c in ("score", "coherent"))
    assert score[pairs[0]] < score[pairs[1]] and score[pairs[2]] < score[pairs[3]] and fits[pairs[4]] and not fits[pairs[5]]


def test_polluted_names_and_places(spark):
    docs = spark.createDataFrame([("CLARANT - 7179 L R PERTOIRE", "STE ALPHA BROKERS", "+=e oe eeveeawus", "TC-OO")], "importateur_nom string, declarant_nom string, pays_achat string, itineraire string")
    got = Q.reject_polluted(docs).first()
    assert (got["importateur_nom"], got["declarant_nom"], got["pays_achat"]) == (None, "STE ALPHA BROKERS", None)
    assert {"importateur_nom_rejected_label_pollution", "pays_achat_rejected_unreadable_country"} <= set(got["reasons"])


def test_cells_of_a_row_stay_together(spark):
    """Cells are told within their row; rows that repeat an id meet, and of their values the least counts."""
    rows = spark.createDataFrame([(1, {"tpl_itineraire": "Rades - Sfax", "tpl_exportateur": "Ateliers Réunis"}), (1, {"tpl_itineraire": "Tunis - Sfax", "tpl_exportateur_nom": "Ateliers Nord"}), (2, {"tpl_block_1": "x"}), (None, {"tpl_destination": "20"}), (3, None)], "id int, zones map<string,string>")
    out = R.zone_fields(rows)
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(1, "exportateur", "ATELIERS NORD"), (1, "exportateur_nom", "ATELIERS NORD"), (1, "itineraire", "RADES-SFAX"), (None, "destination", "20")], out.schema).collect()))
    exchanges = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("field_key" in x for x in exchanges)
