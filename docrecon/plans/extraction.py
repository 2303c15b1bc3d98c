"""Fields found in texts of forms. The forms are written from the columns of the tables, so the SQL states what must be found."""

from pyspark.sql import functions as F

from docrecon.operators import extraction as E
from docrecon.operators.declaration import parse_declarations
from docrecon.operators.embedded import embedded_layout
from docrecon.operators.field_rules import zone_fields
from docrecon.plans import layout
from docrecon.registry import query
from docrecon.sources.tables import spread

K = "o_orderkey"


def rows(spark, d, sql):
    return spread(layout.rows(spark, d, sql))


DAY = "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING))"
DASHED = f"replace({DAY}, '/', '-')"
NUMBER = f"lpad(CAST({K} % 1000000 AS STRING), 6, '0')"
PRICE = "CAST(CAST(o_totalprice AS DECIMAL(14,3)) AS STRING)"
CODES, PLACES = ["TN", "DE", "FR", "NL", "US"], ["TUNISIE", "ALLEMAGNE", "FRANCE", "PAYS BAS", "U.S.A"]


def pick(values, shift=0):
    return f"CASE ({K} + {shift}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


KINDS, SHIPS = ["EA", "IM 4", "T1"], ["NAVIRE", "VOL DU", "BATEAU"]
LABELS = {"origin": "PAYS DE PROVENANCE", "purchase": "PAYS D ACHAT", "first_destination": "PREMIERE DESTINATION", "final_destination": "DESTINATION DEFINITIVE"}
COUNTRY = ", ".join(f"'{label} ', {pick(CODES, i)}, ' ', {pick(PLACES, i)}, chr(10)" for i, label in enumerate(LABELS.values()))
FORM = f"""SELECT {K} AS id, concat(CASE WHEN {K} % 7 = 0 THEN concat('Numéro : ', {NUMBER}, chr(10), 'Date ', {DAY}) ELSE concat('31/02/2020 ', {NUMBER}, ' ', {DAY}) END, chr(10),
'Type Déclaration : ', {pick(KINDS)}, ' ', CAST({K} % 4 + 1 AS STRING), ' ', CAST({K} % 900 + 100 AS STRING), chr(10), 'exp ', lpad(CAST({K} % 10000000 AS STRING), 7, '0'), 'k', chr(10),
{pick(SHIPS)}, ' alpha ', {DAY}, chr(10), CASE WHEN {K} % 5 = 0 THEN 'TN 4 camion' ELSE 'à pied' END, chr(10), CASE WHEN {K} % 2 = 0 THEN 'FOB 1 2' ELSE 'CIF avec le mode de paiement 3 relation 4' END, chr(10),
'code GDT 602 ', {PRICE}, chr(10), '12 BR - TUNIS', chr(10), '301 20 export 3,123456', chr(10), 'ABC-DEF RADES-SFAX', chr(10), '935 / 1234', chr(10), 'D2024AB1C / 1234567', chr(10), {COUNTRY},
'valeur FOB ', {PRICE}, ' douane ', CAST({K} % 1000 + 1000 AS STRING), '.500', chr(10), 'Régime ', CASE WHEN {K} % 3 = 0 THEN '36' ELSE '57' END, chr(10), 'coefficient d''ajustement 1.25', chr(10),
'Code Titre CE 22 Numéro Titre CE ', CAST({K} % 1000000 + 100000 AS STRING), chr(10), 'EXPORTATEUR', chr(10), 'certificat', chr(10), '575 : Clerk ', CAST(o_custkey AS STRING), ' precision', chr(10), 'IMPORTATEUR', chr(10), 'DUPONT SARL', chr(10),
'DECLARANT', chr(10), 'MARTIN ET FILS', chr(10), 'MOYEN répertoire 4321 crédit 98765', chr(10)) AS text FROM orders"""


def form(spark, d, fields, sql=FORM):
    return E.fields(rows(spark, d, sql), fields).drop("text")


@query("ext1_declaration_header", f"SELECT {K} AS id, {NUMBER} AS number, {DASHED} AS date, replace({pick(KINDS)}, ' ', '') AS type, CAST({K} % 4 + 1 AS INT) AS articles, CAST({K} % 900 + 100 AS INT) AS packages, concat(lpad(CAST({K} % 10000000 AS STRING), 7, '0'), 'K') AS exporter_code FROM orders")
def ext1(spark, d):
    return form(spark, d, E.header_fields)


@query("ext2_transport_terms", f"""SELECT {K} AS id, {pick(SHIPS)} AS vehicle, {pick(['7 - MARITIME', '2 - AERIEN', '7 - MARITIME'])} AS mode, CASE WHEN {K} % 5 = 0 THEN '4 - ROUTIER' END AS national_mode, {DASHED} AS arrival,
{pick(['FOB', 'CIF'])} AS terms, {pick(['1', '3'])} AS payment, {pick(['2', '4'])} AS relation FROM orders""")
def ext2(spark, d):
    return form(spark, d, E.transport_fields)


@query("ext4_liquidation", f"""SELECT {K} AS id, '602' AS duty_code, {PRICE} AS duty_total, '12' AS office_code, 'BR - TUNIS' AS office, '301' AS border_office, '20' AS destination, 'EXPORT' AS movement, 'RADES-SFAX' AS route, '935' AS approval, '1234' AS directory,
'D2024AB1C' AS auth_key, '1234567' AS qr_code FROM orders""")
def ext4(spark, d):
    return form(spark, d, E.liquidation_fields)


LABELLED = [f"{c} {'USA' if c == 'US' else p}" for c, p in zip(CODES, PLACES)]


@query("ext5_countries", f"SELECT {K} AS id, " + ", ".join(f"{pick(LABELLED, i)} AS {name}" for i, name in enumerate(LABELS)) + " FROM orders")
def ext5(spark, d):
    return form(spark, d, E.country_fields)


@query("ext6_article_values", f"SELECT {K} AS id, {PRICE} AS fob, concat(CAST({K} % 1000 + 1000 AS STRING), '.500') AS customs, CASE WHEN {K} % 3 = 0 THEN '36' ELSE '57' END AS regime, '1.25' AS adjustment FROM orders")
def ext6(spark, d):
    return form(spark, d, E.article_value_fields)


TITLE_NUMBER = f"CAST({K} % 1000000 + 100000 AS STRING)"
# One for each pattern of a title, in their order; the last three have pairs that aren't plausible or no pattern's form.
TITLE_FORMS = [
    f"'Code Titre CE 22 N° T1TRE CE ', {TITLE_NUMBER}", f"'code t1tre ce 05 n titre ce 123456 / Code Titre CE : 23 Numéro Titre CE ', {TITLE_NUMBER}", f"'boxes 43 : 24 and 44 : ', {TITLE_NUMBER}", f"'532 x 25 y ', {TITLE_NUMBER}, ' z 21 - 11'", f"'532 y 362 x 532 7 and 26 y ', {TITLE_NUMBER}, ' z 21 - 11'",
    f"'43 x 56 44 y ', {TITLE_NUMBER}", f"'TITRE CE 22 A ', {TITLE_NUMBER}", "'43 22 44 880123'",
]
TITLE_FORM = f"SELECT {K} AS id, concat('Déclaration {'x' * 300} ', CASE {K} % 8 " + " ".join(f"WHEN {i} THEN concat({f})" for i, f in enumerate(TITLE_FORMS)) + " END, ' fin') AS text FROM orders"


@query("ext9_titre_ce_pair", f"SELECT {K} AS id, CAST({K} % 8 + 22 AS STRING) AS code, {TITLE_NUMBER} AS number FROM orders WHERE {K} % 8 < 5 AND NOT regexp_matches({TITLE_NUMBER}, '^(880|854)')")
def ext9(spark, d):
    found = E.folded(rows(spark, d, TITLE_FORM)).select("id", F.inline_outer(F.array(E.title_pair(F.col("_t")))))
    return found.where("code is not null")


@query("ext10_party_windows", f"SELECT {K} AS id, concat('575 : CLERK ', CAST(o_custkey AS STRING), ' PRECISION') AS exporter, 'DUPONT SARL' AS importer, 'MARTIN ET FILS' AS declarant FROM orders")
def ext10(spark, d):
    return form(spark, d, E.party_fields)


# Labels with their fields, and what the guided pass must find.
GUIDE = {"directory": ("Répertoire : {}", "4321"), "credit": ("N° crédit {}", "98765"), "guided_office": ("Bureau frontière {}", "301"), "guided_destination": (" destination {}", "20"), "guided_movement": (" localisation : {}", "EXPORT"), "code_qcs": ("code QCS {}", "01"), "qcs": (" QCS {}", "12"), "pfn": (" PFN {}", "345.678"),
         "guided_gross": ("poids brut (kg) {}", "240"), "guided_net": ("poids net (kg) {}", "120"), "stopover": ("N° d''escale {}", "4455"), "heading": ("rubrique {}", "771"), "financial_regime": ("règlement financier {}", "80"), "delay": ("code délai {}", "03"), "oci": ("code OCI {}", "2"), "guided_declarant": ("Déclarant{}", "MARTIN ET FILS"),
         "guided_origin": ("pays de provenance {}", "DE ALLEMAGNE"), "guided_purchase": ("pays d''achat {}", "FR FRANCE"), "guided_first_destination": ("pays première destination {}", "TN TUNISIE"), "guided_final_destination": ("pays destination définitive {}", "NL PAYS BAS")}
VARIES = {"directory": f"CAST({K} % 9000 + 1000 AS STRING)", "pfn": PRICE, "guided_net": f"CAST({K} % 900 + 100 AS STRING)"}


def guide(name):
    """What stands behind a label, as SQL."""
    if name in VARIES:
        return VARIES[name]
    value = GUIDE[name][1]
    return f"'{value[:2] if name.startswith('guided_') and value[2:3] == ' ' else value}'"


def label(name):
    before = GUIDE[name][0].format("")
    return f"'{before}', " + ("chr(10), " if name == "guided_declarant" else "") + guide(name) + ("" if name in ("guided_office", "guided_destination", "code_qcs", "qcs") else ", chr(10)")


GUIDED_FORM = f"SELECT {K} AS id, concat(" + ", ".join(map(label, GUIDE)) + ", 'moyen de transport') AS text FROM orders"


@query("ext18_guided_fields", f"SELECT {K} AS id, " + ", ".join(f"{VARIES.get(n, repr(v))} AS {n}" for n, (_, v) in GUIDE.items()) + " FROM orders")
def ext18(spark, d):
    return form(spark, d, E.guided_fields, GUIDED_FORM).select("id", *GUIDE)


FULL = FORM.replace("'MOYEN répertoire", f"'Devise EUR ', {PRICE}, chr(10), '1 8542319000 TN ', {PRICE}, ' 2 8542319001 DE 7000,250 qcs', chr(10), '602 10.500 1.250000 13.000', chr(10), 'MOYEN répertoire")


@query("ext17_full_declaration_parse", f"""SELECT {K} AS id, {NUMBER} AS number, {DASHED} AS date, {DASHED} AS arrival, 'EUR' AS currency, {PRICE} AS duty_total, {pick(LABELLED)} AS origin, {PRICE} AS fob, 'DUPONT SARL' AS importer, '98765' AS credit, '22' AS title, CAST(2 AS INT) AS articles,
'8542319000' AS hs, {PRICE} AS value, '7000.250' AS second_value, '602' AS tax, '13.000' AS tax_amount, CAST(94 AS INT) AS score FROM orders""")
def ext17(spark, d):
    out = parse_declarations(rows(spark, d, FULL))
    return out.select("id", "header.number", "header.date", "transport.arrival", "financials.currency", "liquidation.duty_total", "countries.origin", "values.fob", "parties.importer", "guided.credit", F.col("title.code").alias("title"), F.size("articles").alias("articles"), F.get("articles", F.lit(0))["hs"].alias("hs"),
                      F.get("articles", F.lit(0))["value"].alias("value"), F.get("articles", F.lit(1))["value"].alias("second_value"), F.get("taxes", F.lit(0))["code"].alias("tax"), F.get("taxes", F.lit(0))["amount"].alias("tax_amount"), "score")


# Every third text tells nothing, and every fifth form has no cells; where both tell a field, the cells say something else.
WEAK, NO_CELLS = f"{K} % 3 = 0", f"{K} % 5 = 0"
CELLS = {"numero_declaration": f"lpad(CAST(({K} + 7) % 1000000 AS STRING), 6, '0')", "date_declaration": "'05/05/2026'", "type_declaration": "'EX1 .'", "pays_achat": "'U.S.A'", "importateur_nom": "'ATELIERS REUNIS DU NORD'", "itineraire": "'Tunis - Rades'", "bureau_douane": "'br - sfax'", "cle_authentification": "'D505ABC1D'", "poids_net": "'120 kg'"}
CELLED = f"SELECT id, CASE WHEN {K} % 3 = 0 THEN 'Texte OCR faible' ELSE text END AS text, CASE WHEN {K} % 5 <> 0 THEN map(" + ", ".join(f"'tpl_{k}', {v}" for k, v in CELLS.items()) + f", 'tpl_block_1', 'left out') END AS zones FROM (SELECT f.*, id AS {K} FROM ({FORM}) f)"


# Forms whose text has the number behind its label only: a number beside its date, such as the cells', goes before it.
LABELLED_NUMBER = f"{K} % 7 = 0"


def either(of_text, of_cell, cell_first=False):
    """What the SQL expects of a field that text and cell tell."""
    cell, text = f"CASE WHEN NOT ({NO_CELLS}) THEN {of_cell} END", f"CASE WHEN NOT ({WEAK}) THEN {of_text} END"
    if cell_first is None:
        return f"CASE WHEN {LABELLED_NUMBER} THEN coalesce({cell}, {text}) ELSE coalesce({text}, {cell}) END"
    return f"coalesce({cell}, {text})" if cell_first else f"coalesce({text}, {cell})"


@query("ext17_parse_with_cells", f"""SELECT {K} AS id, {either(NUMBER, CELLS['numero_declaration'], None)} AS number, {either(DASHED, "'05-05-2026'", None)} AS date, {either(f"replace({pick(KINDS)}, ' ', '')", "'EX1'")} AS type, {either(pick(LABELLED, 1), "'US USA'", True)} AS purchase, {either("'RADES-SFAX'", "'TUNIS-RADES'")} AS route,
coalesce({either("'BR - TUNIS'", "'BR - SFAX'")}, '') AS office, {either("'D2024AB1C'", "'D505ABC1D'")} AS auth_key, {either("'DUPONT SARL'", "'ATELIERS REUNIS DU NORD'")} AS importer, CASE WHEN NOT ({NO_CELLS}) THEN '120' END AS net FROM orders""")
def ext17_cells(spark, d):
    return parse_declarations(rows(spark, d, CELLED)).select("id", "number", "date", "type", "purchase", "route", "office", "auth_key", "importer", "net")


L, HS, VALUE = "l_orderkey * 10 + l_linenumber", "CAST(l_partkey % 10000000 + 80000000 AS STRING)", "CAST(CAST(l_extendedprice AS DECIMAL(12,3)) AS STRING)"
DETAIL = {"code_qcs": "'01'", "qcs": "'12'", "pfn": "'345.678'", "gross": "CAST(l_suppkey % 50 + 200 AS STRING)", "net": "'120'", "fiscal_quality": "'3'", "regime": "'362'", "previous_regime": "'532'", "financial_regime": "'80'", "delay": "'7'", "oci": "'2'", "code": "'22'", "number": "CAST(l_partkey % 1000000 + 1000000 AS STRING)"}
ROW = f"{HS}, ' TN ', {VALUE}, ' qcs 1 12 345.678 poids brut ', {DETAIL['gross']}, ' poids net 120 qualité 3 régimes douaniers 362 532 règlement 80 délai 7 code OCI 2 et 22 ', {DETAIL['number']}, ' fin', chr(10)"
ARTICLES = f"SELECT {L} AS id, concat(CAST(l_linenumber AS STRING), ' ', {ROW}, CAST(l_linenumber AS STRING), ' ', {ROW}, CAST(l_linenumber + 1 AS STRING), ' ', {ROW}) AS text FROM lineitem"


@query("ext7_articles", " UNION ALL ".join(f"SELECT {L} AS id, CAST(l_linenumber + {i} AS INT) AS line, {HS} AS hs, 'TN' AS country, CAST({VALUE} AS DOUBLE) AS value, " + ", ".join(f"{v} AS {k}" for k, v in DETAIL.items()) + " FROM lineitem" for i in (0, 1)))
def ext7(spark, d):
    out = E.articles(rows(spark, d, ARTICLES))
    return out.select("id", "line", "hs", "country", "value", *[k for k in DETAIL if k not in ("code", "number")], "title.code", "title.number")


CODES_ONLY = f"SELECT {L} AS id, concat('Articles', chr(10), '  ', CAST(l_linenumber AS STRING), ' ', {HS}, chr(10), CAST(l_linenumber AS STRING), ' ', {HS}, ' again', chr(10), 'x 5 12345678', chr(10), '9 1234 56 78 901', chr(10)) AS text FROM lineitem"


@query("ext7_text_articles", f"SELECT {L} AS id, CAST(0 AS INT) AS position, CAST(l_linenumber AS INT) AS num_ligne, {HS} AS code_hs FROM lineitem UNION ALL SELECT {L}, 1, 9, '12345678901' FROM lineitem")
def ext7_text(spark, d):
    return E.text_articles(rows(spark, d, CODES_ONLY))


QUANTITY = "CAST(CAST(l_quantity AS BIGINT) AS STRING)"
PRICED = f"SELECT {L} AS id, CASE WHEN l_linenumber % 4 = 0 THEN concat('total ', {VALUE}) ELSE concat(CAST(l_linenumber AS STRING), ' ', {HS}, ' Vis à bois ', {QUANTITY}, ' pcs ', {QUANTITY}, ',5') END AS line FROM lineitem"


@query("ext7_priced_lines", f"""SELECT {L} AS id, CASE WHEN p THEN CAST(l_linenumber AS INT) END AS num_ligne, CASE WHEN p THEN {HS} END AS code_hs, CASE WHEN p THEN 'VIS A BOIS' END AS designation, CASE WHEN p THEN l_quantity END AS quantite, CASE WHEN p THEN 'PCS' END AS unite, CASE WHEN p THEN l_quantity + 0.5 END AS total_ligne,
CASE WHEN p THEN round((l_quantity + 0.5) / l_quantity, 6) END AS prix_unitaire FROM (SELECT *, l_linenumber % 4 <> 0 AS p FROM lineitem)""")
def ext7_priced(spark, d):
    return E.priced_lines(rows(spark, d, PRICED)).drop("line")


EURO = f"concat(CAST({K} % 90 + 10 AS STRING), ' ', lpad(CAST({K} % 1000 AS STRING), 3, '0'), ',50')"
BILL = f"""SELECT {K} AS id, concat('Invoice fa', lpad(CAST({K} % 10000000 AS STRING), 7, '0'), chr(10), CASE WHEN {K} % 2 = 0 THEN 'of 05/06/2025' ELSE 'FOR-COM 01/00/20/02/2019' END, chr(10), 'client cl ', CAST({K} % 900 + 100 AS STRING), chr(10), 'Matricule fiscal : TN123456789', chr(10),
{pick(['paid in TND', 'total in $', 'no currency'])}, chr(10), 'Incoterm : exw.', chr(10), 'Virement 30 jours', chr(10), CASE {K} % 3 WHEN 0 THEN concat('Gross Discount Amount All Taxes Included NET PAY', chr(10), '1 000,00 ', {EURO}) WHEN 1 THEN concat('Gross 2000,00 ', {EURO}, ' Total VAT') ELSE concat('NET PAY : ', {EURO}) END) AS text FROM orders"""


@query("ext14_invoice_header", f"""SELECT {K} AS id, concat('FA', lpad(CAST({K} % 10000000 AS STRING), 7, '0')) AS number, CASE WHEN {K} % 2 = 0 THEN '05/06/2025' END AS date, {pick(['TND', 'USD', 'EUR'])} AS currency, concat('CL', CAST({K} % 900 + 100 AS STRING)) AS client, 'TN123456789' AS tax_id,
'EXW' AS incoterm, 'Virement 30 jours' AS payment, CAST(CASE WHEN {K} % 2 = 0 THEN 0.92 END AS DOUBLE) AS sure FROM orders""")
def ext14(spark, d):
    out = rows(spark, d, BILL).select("id", *[c.alias(k) for k, c in E.invoice_fields(F.col("text")).items()])
    return out.select("id", "number", "date", "currency", "client", "tax_id", "incoterm", "payment", F.col("confidence")["date"].alias("sure"))


@query("ext15_invoice_totals", f"SELECT {K} AS id, CAST(({K} % 90 + 10) * 1000 + {K} % 1000 AS DOUBLE) + 0.5 AS net_pay FROM orders")
def ext15(spark, d):
    return rows(spark, d, BILL).select("id", E.invoice_fields(F.col("text"))["net_pay"].alias("net_pay"))


# Cells of templates as SQL, and the fields that they give.
ZONES = {
    "numero_declaration": (f"concat('n ', {NUMBER}, ' x')", {"numero_declaration": NUMBER}), "date_declaration": (f"concat('le ', {DAY})", {"date_declaration": DASHED}), "type_declaration": ("'type im4 .'", {"type_declaration": "'IM4'"}), "pays_achat": (pick(PLACES[:3]), {"pays_achat": pick(LABELLED[:3])}),
    "pays_destination_finale": ("'US U.S.A'", {"pays_destination_finale": "'US USA'", "pays_destination": "'US USA'"}), "exportateur": (f"concat('Ateliers Réunis ', CAST({K} % 7 AS STRING), ' Numero 12')", {k: f"concat('ATELIERS REUNIS ', CAST({K} % 7 AS STRING))" for k in ("exportateur", "exportateur_nom")}),
    "importateur_nom": ("'Dupont et  fils'", {k: "'Dupont et fils'" for k in ("importateur", "importateur_nom")}), "declarant": ("' MARTIN  FILS '", {k: "'MARTIN FILS'" for k in ("declarant", "declarant_nom", "nom_declarant")}), "nombre_colis": (f"concat('22 ', CAST({K} % 90 + 100 AS STRING), ' 33')", {"nombre_colis": f"CAST({K} % 90 + 100 AS STRING)"}),
    "code_gdt": ("'x 602 603'", {"code_gdt": "'602'"}), "destination": ("'301 020'", {"destination": "'20'"}), "poids_net": ("'120 kg 21'", {"poids_net": "'120'"}), "montant_ptfn": (f"concat('TND ', replace({PRICE}, '.', ','))", {"montant_ptfn": PRICE}), "bureau_douane": ("'12 br -  tunis'", {"bureau_douane": "'BR - TUNIS'"}),
    "itineraire": ("'Rades - Sfax'", {"itineraire": "'RADES-SFAX'"}), "mode_transport": ("' par  AVION'", {"mode_transport": "'par AVION'"}), "importateur": ("'code'", {}), "poids_brut": ("'21 33'", {}), "block_1": ("'left out'", {}), "adresse_exportateur": ("' '", {}),
}


@query("ext12_zone_fields", " UNION ALL ".join(f"SELECT {K} AS id, '{k}' AS field_key, {v} AS value FROM orders" for _, told in ZONES.values() for k, v in told.items()))
def ext12(spark, d):
    zones = rows(spark, d, f"SELECT {K} AS id, map(" + ", ".join(f"'tpl_{k}', {v}" for k, (v, _) in ZONES.items()) + ", 'other', 'left out') AS zones FROM orders")
    return zone_fields(zones)


EMBEDDED = f"""SELECT {K} AS id, concat('Exportateur', chr(10), 'MAISON ', {pick(['NORD', 'SUD'])}, chr(10), 'USA', chr(10), 'Importateur', chr(10), '5751 : ATELIERS REUNIS', chr(10), CAST({K} AS STRING), ' RUE HAUTE', chr(10), 'Déclarant', chr(10), 'MARTIN ET FILS', chr(10), 'Moyen de transport', chr(10),
'Pays de provenance', chr(10), 'US', chr(10), 'U.S.A', chr(10), 'Pays d''achat', chr(10), {pick(CODES[:3])}, chr(10), {pick(PLACES[:3])}, chr(10), 'Pays de première destination', chr(10), 'BELGIQUE', chr(10), 'Pays de destination définitive', chr(10), 'TN', chr(10), 'Moyen', chr(10), '73181520001', chr(10), 'TN', chr(10), '01', chr(10), '120', chr(10), {PRICE}, chr(10), 'D798DDM1W') AS text FROM orders"""
EXPECTED = {"exportateur_nom": "concat('MAISON ', " + pick(["NORD", "SUD"]) + ")", "importateur_nom": "'ATELIERS REUNIS'", "adresse_importateur": "'5751 : ATELIERS REUNIS'", "declarant_nom": "'MARTIN ET FILS'", "code_exportateur": "'5751'", "pays_provenance": "'US USA'", "pays_achat": pick([f"{c} {n}" for c, n in zip(CODES[:3], PLACES[:3])]),
            "pays_premiere_destination": "'BE BELGIQUE'", "pays_destination_finale": "'TN TUNISIE'", "code_sh_ndp": "'73181520001'", "code_pays_origine": "'TN'", "code_qcs": "'01'", "qcs": "'120'", "pfn": PRICE, "montant_ptfn": PRICE, "cle_authentification": "'D798DDM1W'"}


@query("ext13_embedded_layout", " UNION ALL ".join(f"SELECT {K} AS id, '{k}' AS field_key, {v} AS value FROM orders" for k, v in EXPECTED.items()))
def ext13(spark, d):
    return embedded_layout(rows(spark, d, EMBEDDED)).where(F.col("field_key") != "designation_marchandises")
