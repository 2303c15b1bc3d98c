"""Files in and out, embedded layouts, deletions and overrides on small rows."""

import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from docrecon.functions import scalars
from docrecon.operators import history as H
from docrecon.operators.core import compare_inputs, link_one_to_one, reconcile
from docrecon.operators.embedded import embedded_layout
from docrecon.operators.quality import reject_polluted
from docrecon.sources import tables as T


def test_csv_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "x"', None), (1, "a;b", "ü")], "n int, `A b` string, B string")
    want = ["﻿A b;B", '"a;b";"ü"', '"say ""x""";""']
    assert [r[0] for r in T.csv_text(df, ["A b", "B"], ["n"]).collect()] == want
    T.write_history_csv(df.coalesce(1), f"{tmp_path}/csv", ["A b", "B"], ["n"])
    parts = sorted((tmp_path / "csv").glob("part-*"))
    assert "\n".join(p.read_text("utf-8").strip("\n") for p in parts if p.stat().st_size).split("\n") == want


def test_report_lines(spark, tmp_path):
    schema = "invoice_id int, dum_id int, numero_dum string, numero_facture string, pfn double, net_pay double, gap_abs double, aligned boolean, control string, comment string, compared_at timestamp"
    reports = spark.createDataFrame([(7, 3, "001", "FA7", 1.5, None, None, False, None, 'a "b"', datetime(2024, 2, 1, 8, 5, 9)), (8, None, None, None, None, None, None, True, "ok", "", None)], schema)
    rows = spark.createDataFrame([(7, 2, "Devise", "EUR", "USD", "—", "Attention"), (7, 1, "NET", "1.5", "—", "—", "Écart")], "invoice_id int, place int, category string, dum_value string, invoice_value string, gap string, tone string")
    lines = T.report_lines(reports, rows, "test", F.expr("timestamp '2024-02-15 00:00:00'"))
    got = [r["line"] for r in lines.where("invoice_id = 7").orderBy("position").collect()]
    assert got[:3] == ['"Rapport de vérification croisée DUM — Facture"', '"Généré le";"15/02/2024 00:00:00"', '"Source";"test"'] and len(got) == 18
    assert got[8] == '"NET PAY facture";"—"' and got[12:15] == ['"Commentaire";"a ""b"""', '"Date comparaison";"01/02/2024 08:05:09"', ""] and got[16] == '"NET";"1.5";"—";"—";"Écart"'
    T.write_reports(lines, f"{tmp_path}/reports")
    text = "".join(p.read_text("utf-8") for p in sorted((tmp_path / "reports").glob("part-*")))
    assert text.count("﻿") == 2 and not [p for p in (tmp_path / "reports").iterdir() if p.is_dir()]


def test_input_files_and_predictions(spark, tmp_path):
    for name in ("b.PDF", "a.png", "c.txt", "d.tif"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["file"] for r in T.list_input_files(spark, str(tmp_path)).collect()] == ["a.png", "b.PDF", "d.tif"]
    named = spark.createDataFrame([("d.tif",), ("c.txt",)], "file string")
    assert [r["file"] for r in T.list_input_files(spark, str(tmp_path), named).collect()] == ["d.tif"]
    (tmp_path / "p.json").write_text('[{"file": "a.png", "result": {"x": 1, "y": null}}, {"file": "b.PDF", "result": {"x": 2}}]')
    got = {tuple(r) for r in T.read_predictions(spark, f"{tmp_path}/p.json").collect()}
    assert got == {("a.png", "x", "1"), ("a.png", "y", None), ("b.PDF", "x", "2"), ("b.PDF", "y", None)}


def test_folded_text_is_compatibility_decomposition_without_marks(spark):
    def plain(v):
        v = unicodedata.normalize("NFKD", v.replace("™", "T"))
        return "".join(c for c in v if not unicodedata.combining(c)).upper()

    texts = ["Åsa Šofer Ÿ Ý ÿ ß", "œuvre ﬁn ½ ™", "Ǆ é Ά й ё ø đ ł", "ＡＢｃ № ℃", "ı İ ſ K Å", ""]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", scalars.fold_text(F.col("t")).alias("f")).collect()
    assert all(r["f"] == (None if r["t"] is None else plain(r["t"])) for r in got)


def test_year_typos(spark):
    cases = {"31-02-3026": "31-02-3026", "01/02/3026": "01-02-2026", " 05.06.3099": "05-06-2099", "29-02-3024": "29-02-2024", "01-02-2024": "01-02-2024", "le 01-02-3024": "le 01-02-3024", "": ""}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", scalars.fix_year_typo(F.col("c")).alias("x")).collect()
    assert {r["c"]: r["x"] for r in got} == cases


LABELS = "Exportateur\nMAISON NORD\nUSA\nImportateur\nATELIERS REUNIS PRECISION\n113 RUE HAUTE\nDéclarant\nATELIERS REUNIS PRECISION\nPays de provenance\nUS\nU.S.A\nPays d'achat\nTN\nTUNISIE\nPays de première destination\nUS\nU.S.A\nPays de destination définitive\nTN\nTUNISIE\n"
BLOCK = "Exportateur\nImportateur\nMAISON NORD\nUSA\n679925\n12-03-2025\n12 RUE DES FORGES NORD\nATELIERS REUNIS\n1113819W\nATELIERS REUNIS\nSFAX ENTREPOT 4\nSA\n1\n3\n8056\nUS\nTN\nUS\nUS\nU.S.A\nTUNISIE\nU.S.A\nU.S.A\nEXW\nUSD\n1234.500\n3.125\nAVION\n4\nCODE NDP\n5751:ATELIERS REUNIS SA\nVIS ET BOULONS EN ACIER**\n73181520001\nTN\n01\n120\n1234.500\n602 x 13.000\nD798DDM1W\n12 BR - TUNIS\n14-03-2025\n"


def test_embedded_layouts(spark):
    df = spark.createDataFrame([(1, LABELS), (2, BLOCK), (3, None), (4, ""), (5, "Exportateur\nImportateur\nx")], "id int, text string")
    got = {}
    for i, key, value in embedded_layout(df).collect():
        got.setdefault(i, {})[key] = value
    one, two = got[1], got[2]
    assert (one["exportateur_nom"], one["importateur_nom"], one["declarant_nom"]) == ("MAISON NORD", "ATELIERS REUNIS PRECISION", "ATELIERS REUNIS PRECISION")
    assert [one[f"pays_{k}"] for k in ("provenance", "achat", "premiere_destination", "destination_finale")] == ["US USA", "TN TUNISIE", "US USA", "TN TUNISIE"]
    want = {"numero_dae": "679925", "numero_declaration": "8056", "type_declaration": "SA", "code_exportateur": "5751", "exportateur_nom": "ATELIERS REUNIS SA", "pays_provenance": "TN TUNISIE", "pays_achat": "US USA", "pays_destination_finale": "US USA", "code_sh_ndp": "73181520001",
            "cle_authentification": "D798DDM1W", "montant_liquidation": "13.000", "mode_livraison": "EXW", "devise": "USD", "taux_conversion": "3.125", "date_validation": "14-03-2025", "importateur_pays": "US USA"}
    assert {k: two[k] for k in want} == want and "VIS ET BOULONS" in two["designation_marchandises"]
    assert 3 not in got and 4 not in got and 5 not in got


def test_bulk_delete_takes_the_first_two_hundred(spark):
    asked = spark.createDataFrame([(i, str(i)) for i in range(300)] + [(-2, "x"), (-1, " 7 "), (-3, None), (-4, "-3"), (-5, "1.5")], "position long, raw string")
    docs = spark.createDataFrame([(i, 1 if i % 2 else None) for i in range(1, 150)], "id long, user_id int")
    got = {r["id"]: r["outcome"] for r in H.bulk_delete(asked, docs, 1).collect()}
    assert set(got) == set(range(1, 195)) and got[7] == "deleted" and got[8] == "forbidden" and got[180] == "not_found"
    assert {r["outcome"] for r in H.bulk_delete(asked, docs, 1, admin=True).collect()} == {"deleted", "not_found"}
    left = H.survivors(docs, H.bulk_delete(asked, docs, 1))
    assert left.count() == 149 - 75


def test_overrides_and_lost_links(spark):
    dums = spark.createDataFrame([(1, "n1", "validated", None, "EUR", "3", "2", "FOB"), (2, " ", "x", "7,5", " ", None, None, None)], "id int, numero string, statut string, montant_ptfn string, devise string, nombre_colis string, poids_net string, mode_livraison string")
    given = spark.createDataFrame([(1, None, 5.0, " "), (2, 9.0, 1.0, "USD")], "dum_id int, pfn double, declared double, devise string")
    got = {r["dum_id"]: (r["pfn"], r["dum_devise"], r["dum_numero"]) for r in compare_inputs(dums, given).collect()}
    assert got == {1: (5.0, "EUR", "n1"), 2: (9.0, "USD", None)}
    invoices = spark.createDataFrame([(1, 1, datetime(2024, 1, 1), "ok", 1.0), (2, 1, datetime(2024, 1, 2), "error", 2.0), (3, None, None, "ok", 3.0)], "id int, dum_id int, created_at timestamp, statut_controle string, montant_declare_dum double")
    rows = {r["id"]: (r["dum_id"], r["statut_controle"], r["montant_declare_dum"]) for r in link_one_to_one(invoices).collect()}
    assert rows == {1: (None, None, None), 2: (1, "error", 2.0), 3: (None, "ok", 3.0)}


def test_reconciliation_tells_why(spark):
    invoices = spark.createDataFrame([(1, 1, 100.0, None, "eur ", 2, 5.0, "FOB x"), (2, 1, None, 12_000_000.5, "EUR", 3, None, "CIF"), (3, None, None, None, "EUR", 1, 1.0, None)], "id int, dum_id int, net_pay double, montant_ttc double, devise string, nombre_colis int, poids_net double, mode_livraison string")
    inputs = spark.createDataFrame([(1, "001", "validated", 100.005, "USD", 3, 5.4, "fob")], "dum_id int, dum_numero string, dum_statut string, pfn double, dum_devise string, dum_colis int, dum_poids double, dum_mode string")
    got = {r["id"]: r for r in reconcile(invoices, inputs).collect()}
    assert got[1]["status"] == "warning" and got[1]["codes"] == ["currency_mismatch", "montant_net_pay_vs_pfn", "colis_mismatch", "declaration_linked"]
    assert got[1]["comment"] == "Devises différentes : facture=EUR, DUM=USD — vérifiez la comparaison." and got[1]["anomalies"][1]["facture_value"] == "100.0 EUR"
    gap = got[2]["anomalies"][2]
    assert (gap["code"], gap["severity"], gap["message"], gap["facture_value"]) == ("amount_gap", "error", "Écart montant +11999900.4950 (facture − DUM PFN).", "12000000.5")
    assert got[3]["status"] == "error" and got[3]["comment"] == "Montant facture manquant" and got[3]["codes"] == ["invoice_amount_missing"]


def test_tables_of_a_database_in_even_ranges(spark, tmp_path):
    """Ids with a gap and a burst: parts hold about as many rows; a second read takes only what came since; rows without id are kept."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(800).selectExpr("id", "'x' AS v").union(spark.range(1_000_000, 1_000_008).selectExpr("id", "'y'")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'z'"))
    rows.coalesce(1).write.jdbc(url, "t", "append", driver)
    df, high = T.read_jdbc(spark, url, "t", '"id"', parts=4, buckets=4096, **driver)
    assert high == 1_000_007 and sorted(df.collect(), key=str) == sorted(rows.collect(), key=str)
    assert df.rdd.getNumPartitions() <= 7
    sizes = sorted(n for n in df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n)
    assert sizes[-1] <= 300 and len(sizes) >= 4
    more, high = T.read_jdbc(spark, url, "t", '"id"', after=high, **driver)
    assert more.count() == 0 and high == 1_000_007
    spark.sql("SELECT 1000009L AS id, 'new' AS v").write.jdbc(url, "t", "append", driver)
    more, high = T.read_jdbc(spark, url, "t", '"id"', after=high, **driver)
    assert [tuple(r) for r in more.collect()] == [(1_000_009, "new")] and high == 1_000_009


def test_ranges_of_ids():
    assert T.id_ranges([(0, 10), (1, 10), (2, 10), (5, 10)], 100, 10, 2) == [(100, 120), (120, 160)]
    assert T.id_ranges([(0, 1), (9, 99)], 0, 5, 3) == [(0, 50)]


def test_folding_of_all_of_unicode(spark):
    whole = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(whole[i : i + 97])) for i in range(0, len(whole), 97)] + [(-1, None), (-2, "")]
    want = {i: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t.replace("™", "T")) if not unicodedata.combining(x)).upper() for i, t in rows}
    got = {r["i"]: r["f"] for r in scalars.with_folded(spark.createDataFrame(rows, "i int, t string"), "t", "f").collect()}
    # Java and Python may know different versions of Unicode; letters of both are the same.
    assert len(got) == len(want) and sum(got[i] != want[i] for i in want) <= 20, [(i, got[i], want[i]) for i in want if got[i] != want[i]][:3]


def test_pages_by_key(spark):
    rows = spark.sql("SELECT id, IF(id % 11 = 0, NULL, timestamp_seconds((id * 7919) % 1000 * 20000)) AS created_at FROM range(1000)")
    order = [F.desc("created_at"), F.desc("id")]
    want = [tuple(r) for r in rows.orderBy(*order).collect()]
    for skip in (0, 13, 500, 905, 990, 2000):
        got, total = H.deep_page(rows, skip=skip, limit=40)
        assert [tuple(r) for r in got.collect()] == want[skip : skip + 40] and total == 1000
    after, seen = None, []
    while True:
        page = [tuple(r) for r in H.next_page(rows, after, limit=200).collect()]
        if not page:
            break
        seen += page
        after = page[-1][::-1]
    assert seen == want
    got, total = H.page(rows, order, 10, 5)
    assert [tuple(r) for r in got.collect()] == want[10:15] and spark.range(1).select(total.alias("n")).first()["n"] == 1000


def test_polluted_fields(spark):
    docs = spark.createDataFrame([(1, "DUPONT", "x", "sfay  -rades", ["old"]), (2, "N° 5 CODE", "EN ITALIE", "A", None), (3, None, None, None, None)], "id int, importateur string, pays_achat string, itineraire string, reasons array<string>")
    got = {r["id"]: r for r in reject_polluted(docs).collect()}
    assert (got[1]["importateur"], got[1]["pays_achat"], got[1]["itineraire"], got[1]["reasons"]) == ("DUPONT", None, "SFAX-RADES", ["old", "pays_achat_rejected_unreadable_country"])
    assert (got[2]["importateur"], got[2]["pays_achat"], got[2]["itineraire"], got[2]["reasons"]) == (None, "EN ITALIE", None, ["importateur_rejected_label_pollution", "itineraire_rejected_unreadable"])
    assert got[3]["reasons"] == []
