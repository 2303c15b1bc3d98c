"""Candidates, review, cleanup, reference data, page metrics, field views and merged article rows."""

from pyspark.sql import functions as F

from docrecon.operators import quality as Q
from docrecon.operators.extraction import best_party_line
from docrecon.registry import query
from docrecon.sources.tables import over, table

K = "o_orderkey"


def of(spark, d, source, sql):
    return over(spark, d, sql, source)


PACKAGES = f"CAST({K} % 40 + 1 AS STRING)"
PARSED = f"SELECT {K} AS id, 'nombre_colis' AS field_key, {PACKAGES} AS value FROM orders UNION ALL SELECT {K}, 'declarant_nom', 'CODE DECLARANT' FROM orders WHERE {K} % 2 = 1"
OFFERED = f"""SELECT {K} AS id, 'nombre_colis' AS field_key, CASE {K} % 3 WHEN 0 THEN '0' WHEN 1 THEN 'x1' ELSE CAST({K} % 40 + 2 AS STRING) END AS value, CAST({K} % 10 AS DOUBLE) / 10 AS confidence FROM orders
UNION ALL SELECT {K}, 'declarant_nom', 'MARTIN FILS', CAST(0 AS DOUBLE) FROM orders WHERE {K} % 4 <> 3"""


@query("qlt4_candidate_resolution", f"""SELECT {K} AS id, 'nombre_colis' AS field_key, CASE WHEN {K} % 3 = 2 AND {K} % 10 >= 4 THEN CAST({K} % 40 + 2 AS STRING) ELSE {PACKAGES} END AS value, CASE WHEN {K} % 3 = 2 AND {K} % 10 >= 4 THEN 'template' ELSE 'parsed' END AS chosen FROM orders
UNION ALL SELECT {K}, 'declarant_nom', CASE WHEN {K} % 4 = 3 THEN 'CODE DECLARANT' ELSE 'MARTIN FILS' END, CASE WHEN {K} % 4 = 3 THEN 'parsed' ELSE 'template' END FROM orders""")
def qlt4(spark, d):
    return Q.resolve_candidates(of(spark, d, "orders", PARSED), of(spark, d, "orders", OFFERED))


@query("qlt5_review_guardrail", f"""SELECT {K} AS id, CASE WHEN {K} % 3 = 1 AND {K} % 5 <> 0 THEN '' WHEN {K} % 2 = 0 THEN 'declarant_nom,numero_declaration' ELSE 'numero_declaration' END AS review, NOT ({K} % 3 = 1 AND {K} % 5 <> 0) AS manual_review FROM orders""")
def qlt5(spark, d):
    docs = of(spark, d, "orders", f"SELECT {K} AS id, 'n1' AS numero_declaration, CASE WHEN {K} % 2 = 0 THEN 'A' ELSE ' ' END AS declarant_nom, CAST(NULL AS STRING) AS importateur, CASE {K} % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' END AS registration, CASE WHEN {K} % 5 = 0 THEN array('overlap') END AS conflicts FROM orders")
    return Q.review_guardrail(docs).select("id", F.array_join("review", ",").alias("review"), "manual_review")


NOISY = f"""SELECT {K} AS id, CASE {K} % 4 WHEN 0 THEN 'LOCAL' WHEN 1 THEN '5' WHEN 2 THEN '20' ELSE '' END AS destination, CASE WHEN {K} % 5 = 0 THEN 'TYPE X' ELSE 'MARTIN' END AS declarant_nom, CAST({K} % 30 AS STRING) AS poids_brut, CAST({K} % 25 AS STRING) AS poids_net,
CAST({K} % 120 AS STRING) AS code_regime_financier, CASE WHEN {K} % 7 = 0 THEN 'A' ELSE '30' END AS code_delai FROM orders"""


@query("qlt6_cleanup_rules", f"""WITH n AS ({NOISY}), c AS (SELECT *, id % 4 IN (0, 1) AS a, id % 5 = 0 AS b, id % 30 >= 10 AND id % 25 >= 10 AND id % 30 < id % 25 AS inv, id % 120 NOT BETWEEN 1 AND 99 AS r, id % 7 = 0 AS l FROM n)
SELECT id, CASE WHEN NOT a THEN destination END AS destination, CASE WHEN NOT b THEN declarant_nom END AS declarant_nom, CASE WHEN NOT (id % 30 < 10 OR inv) THEN poids_brut END AS poids_brut, CASE WHEN NOT (id % 25 < 10 OR inv) THEN poids_net END AS poids_net,
CASE WHEN NOT r THEN code_regime_financier END AS code_regime_financier, CASE WHEN NOT l THEN code_delai END AS code_delai, concat_ws(',', CASE WHEN a THEN 'destination' END, CASE WHEN b THEN 'declarant_nom' END, CASE WHEN id % 30 < 10 OR inv THEN 'poids_brut' END, CASE WHEN id % 25 < 10 OR inv THEN 'poids_net' END,
CASE WHEN r THEN 'code_regime_financier' END, CASE WHEN l THEN 'code_delai' END) AS reasons FROM c""")
def qlt6(spark, d):
    return Q.cleanup(of(spark, d, "orders", NOISY)).withColumn("reasons", F.array_join("reasons", ","))


SPOILT = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'DUPONT SARL' WHEN 1 THEN 'DUPONT code 12' END AS importateur_nom, CASE WHEN o_orderkey % 4 = 0 THEN 'MARTIN repertoire' ELSE 'MARTIN' END AS declarant, CASE o_orderkey % 5 WHEN 0 THEN 'FR FRANCE' WHEN 1 THEN 'en tunisie' WHEN 2 THEN 'FRANC' WHEN 3 THEN ' ' END AS pays_achat, CASE o_orderkey % 4 WHEN 0 THEN 'rades - sfay' WHEN 1 THEN 'PARIS-LYON' WHEN 2 THEN 'RADES SFAX' END AS itineraire FROM orders"


@query("qlt6_polluted_fields", """WITH p AS (SELECT o_orderkey AS id FROM orders) SELECT id, CASE WHEN id % 3 = 0 THEN 'DUPONT SARL' END AS importateur_nom, CASE WHEN id % 4 <> 0 THEN 'MARTIN' END AS declarant, CASE id % 5 WHEN 0 THEN 'FR FRANCE' WHEN 1 THEN 'en tunisie' WHEN 3 THEN ' ' END AS pays_achat, CASE WHEN id % 4 = 0 THEN 'RADES-SFAX' END AS itineraire,
concat_ws(',', CASE WHEN id % 4 = 0 THEN 'declarant_rejected_label_pollution' END, CASE WHEN id % 3 = 1 THEN 'importateur_nom_rejected_label_pollution' END, CASE id % 4 WHEN 1 THEN 'itineraire_rejected_unexpected_route' WHEN 2 THEN 'itineraire_rejected_unreadable' END, CASE WHEN id % 5 = 2 THEN 'pays_achat_rejected_unreadable_country' END) AS reasons FROM p""")
def qlt6_polluted(spark, d):
    return Q.reject_polluted(of(spark, d, "orders", SPOILT)).withColumn("reasons", F.array_join("reasons", ","))


LONG_TOKENS = "list_distinct(list_filter(string_split(upper(p_name), ' '), lambda t: length(t) >= 4))"


@query("qlt7_referential_flags", f"""WITH s AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN len({LONG_TOKENS}) > 0 THEN 1.0 ELSE 0.0 END WHEN length(p_type) >= 4 AND list_contains({LONG_TOKENS}, p_type) THEN 1.0 / len({LONG_TOKENS}) ELSE 0.0 END AS near FROM part)
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 2 THEN 'importateur_referential_hint_available' WHEN near < 0.35 THEN 'importateur_referential_mismatch' WHEN near < 0.65 THEN 'importateur_referential_partial_match' END AS flag FROM s""")
def qlt7(spark, d):
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    docs = part.select(k.alias("id"), k.alias("code"), F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.col("p_type")).alias("name"))
    return Q.referential_flags(docs, part.where(k % 5 != 0).select(k.alias("code"), F.col("p_name").alias("company"))).select("id", "flag")


METRICS = "SELECT l_partkey * 100000 + l_suppkey * 100 + l_linenumber AS id, 1000 + l_partkey % 1500 AS width, 1400 + l_suppkey * 37 % 2500 AS height, l_quantity AS blur, l_linenumber * 10 AS contrast, l_partkey % 256 AS brightness, l_partkey % 10 * 100000 AS bytes, CASE WHEN l_returnflag = 'A' THEN 'image/jpeg' ELSE 'image/png' END AS content_type FROM lineitem"


@query("qlt8_image_metrics_gate", f"""WITH m AS ({METRICS}), w AS (SELECT *, round(least(width / 8.27::DOUBLE, height / 11.69::DOUBLE), 1) AS dpi FROM m), c AS (SELECT id, bytes, concat_ws(',', CASE WHEN width < 1200 THEN 'resolution_width_low' END, CASE WHEN height < 1600 THEN 'resolution_height_low' END, CASE WHEN dpi < 200 THEN 'estimated_dpi_low' END, CASE WHEN blur < 35 THEN 'image_blurry' END) AS hard,
concat_ws(',', CASE WHEN contrast < 28 THEN 'low_contrast' END, CASE WHEN brightness < 55 THEN 'underexposed' END, CASE WHEN brightness > 220 THEN 'overexposed' END, CASE WHEN content_type = 'image/jpeg' AND bytes < width * height // 12 THEN 'jpeg_heavily_compressed' END) AS soft FROM w)
SELECT id, CASE WHEN bytes = 0 THEN '' ELSE concat_ws(',', nullif(hard, ''), nullif(soft, '')) END AS warnings, CASE WHEN bytes = 0 THEN 0 ELSE len(list_filter(string_split(concat_ws(',', nullif(hard, ''), nullif(soft, '')), ','), lambda x: x <> '')) END AS tips, CASE WHEN bytes = 0 THEN 'fichier_vide' ELSE hard END AS errors, bytes = 0 OR hard <> '' AS block FROM c""")
def qlt8(spark, d):
    return Q.image_gate(of(spark, d, "lineitem", METRICS)).select("id", F.array_join("warnings", ",").alias("warnings"), F.size("advice").alias("tips"), F.array_join("errors", ",").alias("errors"), "block")


VIEW = [("number", [], "header", True), ("exporter", ["exporter_name"], "parties", True), ("value_dinars", ["value_fob", "customs"], "values", False)]
RESULTS = f"SELECT {K} AS id, map('number', CASE WHEN {K} % 3 = 0 THEN ' ' ELSE 'n' END, 'exporter_name', CASE WHEN {K} % 2 = 0 THEN 'E' END, 'customs', '5') AS values, map('number', 95, 'exporter', 40, 'customs', 80) AS confidences FROM orders"


@query("val7_field_view", f"""SELECT {K} AS id, 'number' AS field_key, 'header' AS section, CASE WHEN {K} % 3 = 0 THEN ' ' ELSE 'n' END AS value, 95 AS confidence, {K} % 3 = 0 AS has_error FROM orders
UNION ALL SELECT {K}, 'exporter', 'parties', CASE WHEN {K} % 2 = 0 THEN 'E' ELSE '' END, 40, {K} % 2 = 1 FROM orders UNION ALL SELECT {K}, 'value_dinars', 'values', '5', 80, false FROM orders""")
def val7(spark, d):
    return Q.field_view(of(spark, d, "orders", RESULTS), VIEW)


CELLS = f"SELECT {K} AS doc, 1 AS place, 1 AS page, 1 AS line, 'A' AS hs, CAST(NULL AS STRING) AS quantity, 'u' AS unit FROM orders UNION ALL SELECT {K}, 2, 1, CAST(NULL AS INT), 'B', '5', '' FROM orders"
TEXTS = f"""SELECT {K} AS doc, 1 AS place, 2 AS page, 1 AS line, 'A' AS hs, CAST({K} % 9 AS STRING) AS quantity, 'x' AS unit FROM orders UNION ALL SELECT {K}, 2, 2, 2, 'B', '7', 'kg' FROM orders UNION ALL SELECT {K}, 3, 2, 3, 'C', '1', NULL FROM orders
UNION ALL SELECT {K}, 4, 2, 3, 'C', '2', 'm' FROM orders UNION ALL SELECT {K}, 5, 3, 4, 'B', '8', 'kg' FROM orders WHERE {K} % 2 = 0"""


@query("jn12_article_merge", f"""SELECT {K} AS doc, 1 AS page, 1 AS line, 'A' AS hs, CAST({K} % 9 AS STRING) AS quantity, 'u' AS unit, 'table_cells' AS source FROM orders UNION ALL SELECT {K}, 1, 2, 'B', '5', 'kg', 'table_cells' FROM orders
UNION ALL SELECT {K}, 2, 3, 'C', '1', 'm', 'regex' FROM orders UNION ALL SELECT {K}, 3, 4, 'B', '8', 'kg', 'regex' FROM orders WHERE {K} % 2 = 0""")
def jn12(spark, d):
    return Q.merge_articles(of(spark, d, "orders", CELLS), of(spark, d, "orders", TEXTS), ["quantity", "unit"])


@query("win5_latest_debug_session", "SELECT user_id AS root, max(lpad(CAST(event_id AS STRING), 12, '0')) AS name FROM events GROUP BY 1")
def win5(spark, d):
    return Q.latest_folder(table(spark, d, "events").select(F.col("user_id").alias("root"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("name")))


@query("win7_best_party_line", "SELECT p_partkey, concat('575 : ', upper(p_name), ' SARL') AS line FROM part")
def win7(spark, d):
    name = F.upper("p_name")
    text = F.concat_ws("\n", name, F.concat(F.lit("575 : "), name, F.lit(" SARL")), F.concat(name, F.lit(" CERTIFICAT DE TYPE DECLARATION")), F.lit("IMPORTATEUR"))
    return table(spark, d, "part").select("p_partkey", best_party_line(text).alias("line"))
