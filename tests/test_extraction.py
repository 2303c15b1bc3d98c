"""Fields of texts and candidates on small rows: nulls, empty texts, order of the rules."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docrecon.operators import extraction as E
from docrecon.operators import field_rules as R
from docrecon.operators import quality as Q
from docrecon.operators.declaration import parse_declarations

PARTS = [E.header_fields, E.transport_fields, E.liquidation_fields, E.country_fields, E.article_value_fields, E.party_fields, E.guided_fields]


def fields(spark, text, part):
    df = spark.createDataFrame([(text,)], "text string")
    if part is E.invoice_fields:
        return df.select(*[c.alias(k) for k, c in part(F.col("text")).items()]).first().asDict()
    return E.fields(df, part).drop("text").first().asDict()


@pytest.mark.parametrize("text", [None, "", " \n "])
def test_texts_without_fields(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = parse_declarations(df).select("header.*", "liquidation.*", "countries.*", "values.*", "parties.*", "title").first()
    assert not any(got)
    assert E.articles(df).count() == 0
    bill = fields(spark, text, E.invoice_fields)
    assert bill["number"] is None and bill["date"] is None and bill["net_pay"] is None


def test_header_fallbacks(spark):
    got = fields(spark, "DECLARATION 123456 31/02/2020\nDATE 01.03.2021 nbre colis : 12", E.header_fields)
    assert (got["number"], got["date"], got["packages"]) == ("123456", "01-03-2021", 12)
    assert fields(spark, "654321 05-06-2022\n111111 01-01-2020", E.header_fields)["number"] == "654321"


def test_dates_on_forms_references_are_no_invoice_dates(spark):
    assert fields(spark, "FOR-COM-1/00/20/01/02/2025 x", E.invoice_fields)["date"] is None
    got = fields(spark, "Date : 01/02/2025\nTND", E.invoice_fields)
    assert got["date"] == "01/02/2025" and got["confidence"]["date"] == 0.88 and got["currency"] == "TND"


def test_labelled_totals(spark):
    assert fields(spark, "weight 130,00 NET PAY : 500,00\nNET PAY\n 12 345,60 €", E.invoice_fields)["net_pay"] == 12345.6


def test_title_pairs_are_plausible(spark):
    pair = lambda text: fields(spark, text, lambda m: {"x": E.title_pair(m.text)})["x"]
    assert tuple(pair("43 x 22 y 44 z 123456")) == ("22", "123456")
    assert pair("43 x 56 y 44 z 123456") is None and pair("43 x 22 y 44 z 880123") is None


def test_titles_that_no_pattern_has(spark):
    pair = lambda text: fields(spark, text, lambda m: {"x": E.title_pair(m.text)})["x"]
    assert pair("TITRE CE 22 A 1234567") is None
    assert tuple(pair("CODE T1TRE CE 05 N TITRE CE 123456 CODE TITRE CE 22 NUMERO TITRE CE 654321")) == ("22", "654321")
    assert tuple(pair("532 x 25 y 1234567 z 21 - 11")) == ("25", "1234567") and tuple(pair("43 x 5 44 y 1234567")) == ("5", "1234567")


def test_article_details(spark):
    """What a window tells, with readings that a form's own numbers would give left out; of repeated rows the first."""
    text = "9 8542319000 TN 100,500 QCS 1 12 123.456 Pods brut 80 Pods net 70 fiscale 4 réglement 44 délai 7 OCI 11 code titre ce 24 numéro titre ce 1234567\n9 8542319000 DE 100.500\n1 85 42 31 90 FR 7000.250 poids brut 12 poids net 11 regime 100 200 financier x 81 5 QCI 3 et 22 | 7654321"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    a, b = sorted(E.articles(df).collect(), key=lambda r: r["position"])
    assert (a["line"], a["hs"], a["country"], a["value"], a["code_qcs"], a["qcs"], a["pfn"]) == (9, "8542319000", "TN", 100.5, "01", "12", "123.456")
    assert (a["gross"], a["net"], a["fiscal_quality"], a["oci"], tuple(a["title"])) == ("80", "70", "4", None, ("24", "1234567"))
    assert (b["hs"], b["gross"], b["net"], b["regime"], b["previous_regime"], b["financial_regime"], b["delay"], b["oci"], tuple(b["title"])) == ("85423190", None, None, "100", "200", "81", "5", "3", ("22", "7654321"))


def test_single_lines_and_codes(spark):
    lines = spark.createDataFrame([("3 85423190 Vis à tête 12 pcs 30,6",), ("x",), (None,), ("3 85423190 a 0 U 5",)], "line string")
    got = [tuple(r)[1:] for r in E.priced_lines(lines).collect()]
    assert got == [(3, "85423190", "VIS A TETE", 12.0, "PCS", 30.6, 2.55), (None,) * 7, (None,) * 7, (None,) * 7]
    codes = spark.createDataFrame([(1, "1 8542 31 90\n1 85423190\n 2 1234567890 x\n3 12"), (2, None)], "id int, text string")
    assert [tuple(r) for r in E.text_articles(codes).collect()] == [(1, 0, 1, "85423190"), (1, 1, 2, "1234567890")]


def test_anchor_scores(spark):
    """As SequenceMatcher scores them, down to the least score that counts; few tokens need it."""
    rng = random.Random(1)
    words = ["".join(rng.choices("DECLARNTIOPXY", k=rng.randrange(1, 14))) for _ in range(500)] + ["XDECLARX", "DECIARANT", "DECLRANT", "", None]
    df = spark.createDataFrame([(w,) for w in words + words[:50]], "token string")
    variants = R.ANCHORS["declarant"]
    want = []
    for w in words + words[:50]:
        best = 1.0 if w and any(v in w for v in variants) else max(SequenceMatcher(None, w or "", v).ratio() for v in variants)
        want.append((w, best if best >= R.LEAST_LIKENESS else 0.0))
    assert sorted(map(tuple, R.anchor_scores(df, variants).collect()), key=str) == sorted(want, key=str)
    assert R.anchor_pairs(df, variants).select("token").distinct().count() < len(set(words)) / 10


def test_candidates(spark):
    parsed = spark.createDataFrame([(1, "nombre_colis", "12"), (2, "nombre_colis", " "), (3, "x", None)], "id int, field_key string, value string")
    template = spark.createDataFrame([(1, "nombre_colis", "abc", 1.0), (2, "nombre_colis", "7", None), (4, "x", "", 1.0)], "id int, field_key string, value string, confidence double")
    got = {r["id"]: (r["value"], r["chosen"]) for r in Q.resolve_candidates(parsed, template).collect()}
    assert got == {1: ("12", "parsed"), 2: ("7", "template"), 3: (None, "parsed"), 4: (None, "parsed")}


def test_article_rows_that_are_only_in_one_source(spark):
    schema = "doc int, place int, page int, line int, hs string, unit string"
    cells = spark.createDataFrame([(1, 1, 1, None, "A", ""), (1, 2, 1, 5, "B", "u")], schema)
    texts = spark.createDataFrame([(1, 1, 2, 3, "A", "kg"), (1, 2, 2, 4, "A", "m"), (2, 1, 1, 1, "A", None)], schema)
    got = sorted(map(tuple, Q.merge_articles(cells, texts, ["unit"]).collect()), key=str)
    assert got == sorted([(1, 1, 3, "A", "kg", "table_cells"), (1, 1, 5, "B", "u", "table_cells"), (1, 2, 4, "A", "m", "regex"), (2, 1, 1, "A", None, "regex")], key=str)
    assert Q.merge_articles(cells.limit(0), texts.limit(0), ["unit"]).count() == 0


def test_an_approval_apart_from_its_directory_goes_first(spark):
    got = lambda text: [fields(spark, text, E.liquidation_fields)[k] for k in ("approval", "directory")]
    assert got("Numéro : 935014 / 935 / 1234") == ["935", "1234"] and got("935123.450 / 935 4321") == ["935", "4321"]
    assert got("935014") == ["935", "014"] and got("9351 1234") == [None, None]


def test_labels_of_a_title_outweigh_its_number(spark):
    text = "Code Titre CE 22 Numéro Titre CE {}"
    df = spark.createDataFrame([(1, text.format("880123")), (2, text.format("654321")), (3, "43 x 22 y 44 z 880123")], "id int, text string")
    assert sorted(map(tuple, parse_declarations(df).select("id", "title.code", "title.number").collect())) == [(1, "22", "880123"), (2, "22", "654321"), (3, None, None)]
