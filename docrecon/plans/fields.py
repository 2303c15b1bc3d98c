"""Scalar rules over columns, lists of fields, flags and simple filters and sorts."""

from pyspark.sql import functions as F

from docrecon.functions import scalars as S
from docrecon.operators import field_rules as R
from docrecon.operators.core import known_columns
from docrecon.operators.extraction import bounded, country_label, party_score
from docrecon.operators.history import page
from docrecon.operators.quality import fields_to_correct
from docrecon.registry import query
from docrecon.sources.tables import WITH, over, table

K = "o_orderkey"


def orders(spark, d, sql):
    return over(spark, d, f"SELECT {K} AS id, {sql} FROM orders", "orders")


@query("flt5_reports_only", WITH + "SELECT id FROM v_invoices WHERE dum_id IS NOT NULL OR montant_ttc IS NOT NULL")
def flt5(spark, d):
    return table(spark, d, "v_invoices").where("dum_id is not null or montant_ttc is not null").select("id")


@query("flt10_project_known_columns", WITH + "SELECT id, numero, devise FROM v_declarations")
def flt10(spark, d):
    results = table(spark, d, "v_declarations").withColumns({"taxes": F.lit(1), "erreur": F.lit("x"), "storage": F.lit("s")})
    return known_columns(results, ["id", "numero", "devise", "taxes", "erreur", "storage", "not_there"])


FIELDS = f"'header' AS section, concat('k', CAST({K} % 3 AS STRING)) AS field_key, CASE WHEN {K} % 4 = 0 THEN ' ' WHEN {K} % 4 = 1 THEN 'b' ELSE 'a' END AS value, 'a' AS ocr_value, CAST({K} % 100 AS INT) AS confidence, {K} % 50 = 0 AS has_error, {K} - {K} % 16 AS doc"


@query("flt11_fields_needing_correction", f"""WITH f AS (SELECT {K} AS id, {FIELDS} FROM orders) SELECT doc, section, count(*) AS n, count(*) FILTER (trim(value) = '') AS empty, count(*) FILTER (confidence < 80) AS low, count(*) FILTER (trim(value) <> ocr_value) AS modified, string_agg(CAST(id AS STRING), ',' ORDER BY confidence, id) AS ids
FROM f WHERE trim(value) = '' OR confidence < 80 OR has_error OR trim(value) <> ocr_value GROUP BY doc, section""")
def flt11(spark, d):
    out = fields_to_correct(orders(spark, d, FIELDS))
    return out.select("doc", "section", "n", "empty", "low", "modified", F.array_join(F.transform("fields", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("srt2_document_list", WITH + "SELECT id, numero, created_at FROM v_declarations ORDER BY created_at DESC, id DESC LIMIT 100")
def srt2(spark, d):
    return table(spark, d, "v_declarations").select("id", "numero", "created_at").transform(lambda df: page(df, [F.desc("created_at"), F.desc("id")], 0, 100)[0])


@query("srt4_users_by_id", WITH + "SELECT id, username FROM v_users ORDER BY id LIMIT 50 OFFSET 10")
def srt4(spark, d):
    return table(spark, d, "v_users").select("id", "username").transform(lambda df: page(df, [F.col("id")], 10, 50)[0])


@query("set2_flag_union", f"SELECT {K} AS id, CASE {K} % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'a,c' ELSE 'a' END AS flags FROM orders")
def set2(spark, d):
    df = orders(spark, d, f"array('a', 'a') AS x, CASE {K} % 3 WHEN 0 THEN array('b') WHEN 1 THEN array('c', 'a') END AS y")
    return df.select("id", F.array_join(R.union_flags(F.col("x"), F.col("y")), ",").alias("flags"))


@query("src9_content_type_gate", f"SELECT {K} AS id, CASE WHEN {K} % 4 IN (0, 2) THEN NULL ELSE 'content_type_not_allowed' END AS reason FROM orders")
def src9(spark, d):
    df = orders(spark, d, f"CASE {K} % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/plain' ELSE 'application/octet-stream' END AS kind, CASE {K} % 4 WHEN 2 THEN 'A.PDF' ELSE 'a.exe' END AS name")
    return df.select("id", R.rejected_content(F.col("kind"), F.col("name")).alias("reason"))


@query("src4_parse_json_columns", f"SELECT {K} AS id, CASE WHEN {K} % 3 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN {K} % 3 = 0 THEN 'x' END AS code FROM orders")
def src4(spark, d):
    df = orders(spark, d, f"CASE {K} % 3 WHEN 0 THEN '[{{\"code\": \"x\"}}, null, {{\"code\": \"y\"}}]' WHEN 1 THEN '{{broken' END AS raw")
    return df.select("id", R.json_rows(F.col("raw"), "code: string").alias("r")).select("id", F.size("r").alias("n"), F.get("r", F.lit(0))["code"].alias("code"))


NOISY = f"concat('-', CAST({K} % 900 AS STRING), ',5 EUR')"


@query("scl2_parse_int_amount", f"SELECT {K} AS id, CAST(round_even({K} % 900 + 0.5, 0) AS INT) AS whole FROM orders")
def scl2(spark, d):
    return orders(spark, d, f"concat(' ', CAST({K} % 900 AS STRING), ',5') AS c").select("id", S.parse_int_amount(F.col("c")).alias("whole"))


@query("scl3_amount_eu", f"SELECT {K} AS id, CAST({K} % 900 AS DOUBLE) + 0.5 AS amount FROM orders")
def scl3(spark, d):
    return orders(spark, d, f"{NOISY} AS c").select("id", S.amount_eu(F.col("c")).alias("amount"))


@query("scl4_clean_amount", f"SELECT {K} AS id, concat('-', CAST({K} % 90 AS STRING), '123.50') AS amount FROM orders")
def scl4(spark, d):
    return orders(spark, d, f"concat('- ', CAST({K} % 90 AS STRING), '.123,50 TND') AS c").select("id", S.clean_amount(F.col("c")).alias("amount"))


@query("scl5_number_parsers", f"SELECT {K} AS id, CAST({K} % 900 AS DOUBLE) + 0.5 AS safe, -(CAST({K} % 900 AS DOUBLE) + 0.5) AS coherence, -(CAST({K} % 900 AS DOUBLE) + 0.55) AS lenient FROM orders")
def scl5(spark, d):
    c = F.col("c")
    return orders(spark, d, f"{NOISY} AS c").select("id", S.safe_float(c).alias("safe"), S.coherence_number(c).alias("coherence"), S.lenient_float(F.concat(c, F.lit(".5"))).alias("lenient"))


DAY = "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '{0}', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '{0}', CAST(year(o_orderdate) AS STRING))"


@query("scl6_normalize_date", f"SELECT {K} AS id, CASE WHEN {K} % 5 <> 0 THEN {DAY.format('-')} END AS date FROM orders")
def scl6(spark, d):
    return orders(spark, d, f"CASE WHEN {K} % 5 = 0 THEN '30/02/2020' ELSE {DAY.format('/')} END AS c").select("id", S.normalize_date(F.col("c")).alias("date"))


@query("scl7_fix_year_typo", f"SELECT {K} AS id, CASE {K} % 4 WHEN 0 THEN {DAY.format('-')} WHEN 2 THEN concat('31-02-30', lpad(CAST({K} % 100 AS STRING), 2, '0')) ELSE 'le 01/02/3024' END AS date FROM orders WHERE NOT ({K} % 4 = 1)")
def scl7(spark, d):
    # Right dates with slashes, years 3000 to 3099 of dates that are none, and other text.
    df = orders(spark, d, f"CASE {K} % 4 WHEN 0 THEN {DAY.format('/')} WHEN 2 THEN concat('31.02.30', lpad(CAST({K} % 100 AS STRING), 2, '0')) ELSE 'le 01/02/3024' END AS c").where("id % 4 <> 1")
    return df.select("id", S.fix_year_typo(F.col("c")).alias("date"))


@query("scl7_fix_year_typo_right", f"SELECT {K} AS id, concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-20', lpad(CAST({K} % 100 AS STRING), 2, '0')) AS date FROM orders WHERE day(o_orderdate) < 29")
def scl7_right(spark, d):
    df = orders(spark, d, f"concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), CASE WHEN {K} % 2 = 0 THEN '/' ELSE '-' END, lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.30', lpad(CAST({K} % 100 AS STRING), 2, '0')) AS c, day(o_orderdate) AS day").where("day < 29")
    return df.select("id", S.fix_year_typo(F.col("c")).alias("date"))


@query("scl9_normalize_ocr_noise", f"SELECT {K} AS id, concat('DECLARATION ', CAST({K} AS STRING), ' USD', chr(10), chr(10), 'POIDS USA DOUANE COEF. D''AJUSTEMENT L''AVION') AS text, concat('L''AVION ', CAST({K} AS STRING)) AS display FROM orders")
def scl9(spark, d):
    df = orders(spark, d, f"concat(' Dectaration   ', CAST({K} AS STRING), ' U5D', chr(10), chr(10), chr(10), 'paida SAT douane coef D`ajustem L’AVION ') AS c, concat(' L`AVION  ', CAST({K} AS STRING), ' ') AS e")
    return df.select("id", S.normalize_noise(F.col("c")).alias("text"), S.normalize_noise(F.col("e")).alias("display"))


@query("scl10_normalize_field_text", f"SELECT {K} AS id, CASE {K} % 4 WHEN 0 THEN '05-06-2024' WHEN 1 THEN CAST({K} AS STRING) WHEN 2 THEN 'DUPONT TN' ELSE 'made in USA' END AS text FROM orders")
def scl10(spark, d):
    df = orders(spark, d, f"CASE {K} % 4 WHEN 0 THEN 'date_declaration' WHEN 1 THEN 'poids_net' WHEN 2 THEN 'importateur' ELSE 'remarque' END AS k, CASE {K} % 4 WHEN 0 THEN 'le 05/06/2024' WHEN 1 THEN concat(CAST({K} AS STRING), ' kg') WHEN 2 THEN ' - Dupont   1N :' ELSE 'made in U S A' END AS c")
    return df.select("id", S.field_text(F.col("k"), F.col("c")).alias("text"))


@query("scl11_country_label", f"SELECT {K} AS id, CASE {K} % 3 WHEN 0 THEN 'TN TUNISIE' WHEN 1 THEN 'US USA' ELSE 'ZZ' END AS label FROM orders")
def scl11(spark, d):
    return orders(spark, d, f"CASE {K} % 3 WHEN 0 THEN '1N' WHEN 1 THEN 'US' ELSE 'ZZ' END AS c").select("id", country_label(F.col("c")).alias("label"))


@query("scl11_country_in_text", f"SELECT {K} AS id, CASE {K} % 6 WHEN 0 THEN 'TN TUNISIE' WHEN 1 THEN 'US USA' WHEN 2 THEN 'DE ALLEMAGNE' WHEN 3 THEN 'NL PAYS BAS' WHEN 4 THEN 'TN TUNISIE' END AS label FROM orders")
def scl11_text(spark, d):
    df = orders(spark, d, f"CASE {K} % 6 WHEN 0 THEN 'vers la Tunisie' WHEN 1 THEN 'made in U.S.A ' WHEN 2 THEN concat('France ou DE ', CAST({K} AS STRING)) WHEN 3 THEN 'les pays   bas' WHEN 4 THEN 'x 1N/FR' ELSE 'DEUX' END AS c")
    return df.select("id", R.country_in(F.col("c")).alias("label"))


@query("scl12_normalize_codes", f"SELECT {K} AS id, CASE {K} % 3 WHEN 0 THEN concat('CL', CAST({K} % 900 + 100 AS STRING)) WHEN 1 THEN CAST({K} % 9000 + 1000 AS STRING) END AS code, CASE {K} % 4 WHEN 0 THEN '1113819W' WHEN 1 THEN '1113819W' WHEN 2 THEN concat(lpad(CAST({K} % 1000000 AS STRING), 6, '0'), 'K') END AS exporter FROM orders")
def scl12(spark, d):
    df = orders(spark, d, f"CASE {K} % 3 WHEN 0 THEN concat('cl ', CAST({K} % 900 + 100 AS STRING)) WHEN 1 THEN concat('(', CAST({K} % 9000 + 1000 AS STRING), ')') ELSE ' ' END AS c, CASE {K} % 4 WHEN 0 THEN '1113819 Ow' WHEN 1 THEN '1113819w' WHEN 2 THEN concat(lpad(CAST({K} % 1000000 AS STRING), 6, '0'), ' k') ELSE ' ' END AS e")
    return df.select("id", S.importer_code(F.col("c")).alias("code"), R.exporter_code(F.col("e")).alias("exporter"))


@query("scl13_party_line_score", "SELECT p_partkey, length(regexp_replace(upper(p_name), '[^A-Z]', '', 'g')) + CASE p_partkey % 3 WHEN 0 THEN 4 + 35 WHEN 1 THEN 85 ELSE 10 - 60 END AS score FROM part")
def scl13(spark, d):
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat("p_name", F.lit(" sarl"))).when(k == 1, F.concat(F.lit("575 : "), "p_name")).otherwise(F.concat("p_name", F.lit(" certificat")))
    return table(spark, d, "part").select("p_partkey", party_score(line).cast("long").alias("score"))


@query("scl13_preferred_party", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN concat('575 : ', p_name) ELSE concat(p_name, ' abcdefghi') END AS name FROM part")
def scl13_preferred(spark, d):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    new = F.when(k == 0, F.concat(name, F.lit(" abcdefgh"))).when(k == 1, F.concat(F.lit("575 : "), name)).otherwise(F.concat(name, F.lit(" abcdefghi")))
    return table(spark, d, "part").select("p_partkey", R.preferred_party(name, new).alias("name"))


TOKENS = f"CASE {K} % 40 WHEN 0 THEN 'LEDECLARANT' WHEN 1 THEN 'DECIARANT' ELSE concat('X', CAST({K} AS STRING), CASE {K} % 3 WHEN 0 THEN 'PAYS' WHEN 1 THEN 'CODE' ELSE 'TRAND' END) END AS token"


# What SequenceMatcher gives for the one misread token is stated; all others have too few letters of the label.
@query("scl15_anchor_fuzzy_score", f"SELECT {K} AS id, CASE {K} % 40 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN 16.0 / CAST(18 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM orders")
def scl15(spark, d):
    return R.anchor_scores(orders(spark, d, TOKENS), R.ANCHORS["declarant"]).select("id", "score")


def letters(c, word):
    return " + ".join(f"least({word.count(x)}, length({c}) - length(replace({c}, '{x}', '')))" for x in sorted(set(word)))


@query("scl15_anchor_bound", f"WITH t AS (SELECT {K} AS id, {TOKENS} FROM orders) SELECT id, 2.0 * ({letters('token', 'DECLARANT')}) / CAST(length(token) + 9 AS DOUBLE) AS bound FROM t")
def scl15_bound(spark, d):
    return orders(spark, d, TOKENS).select("id", R.likeness_bound(F.col("token"), "DECLARANT").alias("bound"))


@query("scl16_form_number_guard", f"SELECT {K} AS id, CASE WHEN {K} % 120 BETWEEN 1 AND 99 AND NOT {K} % 120 BETWEEN 5 AND 24 AND NOT {K} % 120 BETWEEN 30 AND 67 THEN CAST({K} % 120 AS INT) END AS articles FROM orders")
def scl16(spark, d):
    return orders(spark, d, f"CAST({K} % 120 AS STRING) AS c").select("id", bounded(F.col("c"), 1, 99).alias("articles"))


@query("scl16_form_values", f"SELECT {K} AS id, {K} % 120 BETWEEN 5 AND 24 OR {K} % 120 BETWEEN 30 AND 67 OR {K} % 120 = 104 AS form, {K} % 120 BETWEEN 1 AND 9 AS small FROM orders")
def scl16_values(spark, d):
    return orders(spark, d, f"concat(' ', CAST({K} % 120 AS STRING)) AS c").select("id", R.form_case(F.col("c"), ["104"]).alias("form"), R.small_code(F.col("c")).alias("small"))


# Field, value, kind and whether the value is valid: one of each kind, told or by the name of the field.
VALUES = [
    ("numero_declaration", "123456", "declaration_id", True), ("date_declaration", "le 01/02/2024", "date_tn", True), ("type_declaration", "im 4", "type_declaration", True), ("nbre_articles", "123456", "small_int", False), ("nombre_colis", "000", "colis", False), ("exportateur_code", "-a-", "alnum_code", False), ("declarant_code", "09", "declarant_code", False),
    ("num_repertoire", "4321", "repertoire", True), ("poids_net", "12,5", "weight", True), ("douane", "12 500", "amount", False), ("exportateur_nom", "MAISON NORD", "name_block", True), ("exportateur_area", "NUMERO 12 DUPONT", "name_block", False), ("adresse_declarant", "x", "address_block", True), ("pays_achat", "FR", "country", True),
    ("block_finances", "123456789", "block_text", False), ("regime", "7", "regime_delai", True), ("qualite_fiscale", "?", "non_empty", True), ("poids_total", "12 kg", "weight", False), ("block_x", "1234567890", "block_text", True), ("pays_x", "EN TUNISIE", "country", True), ("address_x", "CODE", "address_block", True), ("nom_x", "Jean", "name_block", False),
    ("code_date", "01-02-2024", "date_tn", True), ("remarque", " ", "non_empty", False),
]

def one_of(values, at):
    show = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return f"CASE {K} % {len(values)} " + " ".join(f"WHEN {i} THEN {show(v[at])}" for i, v in enumerate(values)) + " END"


@query("scl17_field_validators", f"SELECT {K} AS id, {one_of(VALUES, 0)} AS field_key, {one_of(VALUES, 2)} AS kind, {one_of(VALUES, 3)} AS valid FROM orders")
def scl17(spark, d):
    return R.validated(orders(spark, d, f"{one_of(VALUES, 0)} AS field_key, {one_of(VALUES, 1)} AS value")).select("id", "field_key", "kind", "valid")


@query("scl18_alias_coalesce", f"""SELECT {K} AS id, CASE {K} % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS importateur, CASE WHEN {K} % 2 = 0 THEN 'douane' ELSE '7.50' END AS valeur_dinars, '7.50' AS valeur_fob_dt, CASE {K} % 2 WHEN 0 THEN '301' END AS bureau_frontiere, '1200.5' AS poids_net, CASE WHEN {K} % 2 = 0 THEN 'SFAX-RADES' ELSE 'TUNIS-SFAX' END AS itineraire,
CASE WHEN {K} % 3 = 0 THEN '1' END AS relation_acheteur_vendeur FROM orders""")
def scl18(spark, d):
    df = orders(spark, d, f"CASE {K} % 3 WHEN 0 THEN 'A' ELSE 'null' END AS importateur, CASE {K} % 3 WHEN 1 THEN 'B' ELSE ' ' END AS importateur_nom, CASE WHEN {K} % 2 = 0 THEN ' douane' ELSE 'N/A' END AS douane, '7,50' AS valeur_fob, CAST(NULL AS STRING) AS valeur_fob_dt, '-' AS valeur_dinars, CASE {K} % 2 WHEN 0 THEN '301' ELSE ' 46' END AS bureau_frontiere, '1 200,5' AS poids_net, CASE WHEN {K} % 2 = 0 THEN ' fax-rades' ELSE 'TUNIS-SFAX' END AS itineraire, CASE {K} % 3 WHEN 0 THEN '1' WHEN 1 THEN '08' ELSE '0' END AS relation_acheteur_vendeur")
    out = R.fill_aliases(df).drop("importateur_nom", "douane", "valeur_fob")
    # An amount that was filled from another name keeps its comma; the second pass reads it as a decimal.
    return R.fill_aliases(out).withColumn("valeur_dinars", F.replace("valeur_dinars", F.lit(","), F.lit(".")))


@query("scl20_display_labels", WITH + """, l AS (SELECT id, CASE WHEN id % 3 > 0 THEN numero END AS n, CASE WHEN id % 4 > 0 THEN date_declaration END AS d FROM v_declarations) SELECT id, CASE WHEN n IS NULL AND d IS NULL THEN concat('DUM #', CAST(id AS STRING)) ELSE concat_ws(' · ', 'N° déclaration ' || n, 'Date déclaration ' || d) END AS dum,
concat_ws(' · ', CASE WHEN n IS NULL AND d IS NULL THEN concat('DUM #', CAST(id AS STRING)) ELSE concat_ws(' · ', 'N° déclaration ' || n, 'Date déclaration ' || d) END, concat('N° facture ', CAST(id AS STRING))) AS pair, coalesce(n, concat('Doc #', CAST(id AS STRING))) AS short, d AS short_date FROM l""")
def scl20(spark, d):
    number, date = F.when(F.col("id") % 3 > 0, F.col("numero")), F.when(F.col("id") % 4 > 0, F.col("date_declaration"))
    dum, parts = R.document_line("dum", number, date, F.col("id")), R.compact_parts(number, date, F.col("id"))
    return table(spark, d, "v_declarations").select("id", dum.alias("dum"), R.pair_line(dum, R.document_line("invoice", F.col("id"), F.lit(" "), F.col("id"))).alias("pair"), parts["number"].alias("short"), parts["date"].alias("short_date"))
