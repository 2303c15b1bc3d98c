"""Joins and set operations."""

from pyspark.sql import functions as F

from docrecon.operators import history as H
from docrecon.operators.reports import corrections_per_document
from docrecon.registry import query
from docrecon.sources.tables import NOW, WITH, table


@query("jn1_session_document", WITH + "SELECT s.id, s.document_id, d.numero, s.status FROM v_sessions s JOIN v_declarations d ON d.id = s.document_id")
def jn1(spark, d):
    dums = table(spark, d, "v_declarations").select(F.col("id").alias("document_id"), "numero")
    return table(spark, d, "v_sessions").join(dums, "document_id").select("id", "document_id", "numero", "status")


@query("jn2_correction_timeline", WITH + """SELECT s.document_id, row_number() OVER (PARTITION BY s.document_id ORDER BY c.changed_at DESC, c.id DESC) AS position, count(*) OVER (PARTITION BY s.document_id) AS total, c.id, f.field_key, c.old_value, c.new_value, c.action_type, u.username, c.changed_at
FROM v_corrections c JOIN v_sessions s ON s.id = c.session_id LEFT JOIN v_fields f ON f.id = c.extracted_field_id LEFT JOIN v_users u ON u.id = c.changed_by""")
def jn2(spark, d):
    return H.correction_timeline(*[table(spark, d, t) for t in ("v_corrections", "v_sessions", "v_fields", "v_users")])


OWNED = """, users AS (SELECT id, CASE WHEN id % 9 = 0 THEN ' ' ELSE username END AS username, CASE WHEN id % 18 = 0 THEN NULL ELSE email END AS email FROM v_users WHERE id % 31 <> 0), owned AS (SELECT i.*, coalesce(t.username, nullif(trim(u.username), ''), nullif(trim(u.email), ''), CASE WHEN i.user_id IS NOT NULL THEN concat('Utilisateur #', CAST(i.user_id AS STRING)) END) AS owner FROM v_invoices i
LEFT JOIN (SELECT * FROM (SELECT document_id, trim(username) AS username, row_number() OVER (PARTITION BY document_id ORDER BY uploaded_at DESC, id DESC) AS n FROM v_traces WHERE trim(username) <> '') WHERE n = 1) t ON t.document_id = i.id LEFT JOIN users u ON u.id = i.user_id)"""
HISTORY = WITH + OWNED + """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(ended_at, started_at) DESC, id) AS n FROM v_sessions) WHERE n = 1),
said AS (SELECT d.*, CASE WHEN l.status IN ('validated', 'rejected', 'in_progress') THEN l.status ELSE d.statut END AS s, l.ended_at AS validated_at, v.username AS validator FROM v_declarations d LEFT JOIN last l ON l.document_id = d.id LEFT JOIN v_users v ON v.id = l.validator_id),
hist AS (SELECT s.id AS document_id, coalesce(nullif(numero, ''), fichier, concat('Document #', CAST(s.id AS STRING))) AS document, numero AS numero_declaration, date_declaration, fichier, o.username AS owner, strftime(created_at, '%Y-%m-%d') AS date, created_at,
CASE s WHEN 'validated' THEN 'Validé' WHEN 'rejected' THEN 'Rejeté' WHEN 'in_progress' THEN 'En cours' WHEN 'processing' THEN 'En cours' ELSE 'En attente' END AS status, CASE s WHEN 'validated' THEN 'success' WHEN 'rejected' THEN 'danger' ELSE 'warning' END AS tone, score_confiance AS score, validated_at, validator FROM said s LEFT JOIN v_users o ON o.id = s.user_id),
corr AS (SELECT s.document_id, count(*) AS corrections FROM v_corrections c JOIN v_sessions s ON s.id = c.session_id GROUP BY 1),
bydum AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dum_id ORDER BY created_at DESC, id DESC) AS n FROM owned WHERE dum_id IS NOT NULL) WHERE n = 1),
items AS (SELECT 'dum' AS type, 'DUM' AS type_label, h.document_id AS id, h.document AS reference, h.fichier AS file_name, h.owner, h.created_at, h.status, CASE h.status WHEN 'Validé' THEN 'validated' WHEN 'Rejeté' THEN 'rejected' WHEN 'En cours' THEN 'in_progress' ELSE 'pending' END AS filter_key,
CASE WHEN i.id IS NULL THEN '—' ELSE concat('Facture ', i.numero) END AS reconciliation, CASE i.statut_controle WHEN 'ok' THEN 'Conforme' WHEN 'warning' THEN 'Attention' WHEN 'error' THEN 'Écart' ELSE '—' END AS control_label, i.numero AS partner_number, i.date_facture AS partner_date,
CASE WHEN i.id IS NOT NULL THEN i.statut = 'valide' END AS partner_validated, i.compared_at IS NOT NULL OR i.statut_controle IS NOT NULL AS reconciled, i.statut_controle AS control, i.montant_declare_dum AS pfn, i.net_pay, i.ecart_montant AS gap, coalesce(i.devise_declaree_dum, i.devise) AS currency, i.compared_at,
h.document_id AS dum_id, i.id AS invoice_id, CAST(coalesce(corrections, 0) AS STRING) AS corrections, h.status = 'Validé' AS validated FROM hist h LEFT JOIN bydum i ON i.dum_id = h.document_id LEFT JOIN corr ON corr.document_id = h.document_id
UNION ALL SELECT 'invoice', 'Facture', i.id, i.numero, i.fichier, i.owner, i.created_at, CASE i.statut WHEN 'extracted' THEN 'Extrait' ELSE 'Validé' END, CASE WHEN compared_at IS NOT NULL THEN 'reconciled' WHEN i.statut = 'valide' THEN 'validated' ELSE 'in_progress' END,
CASE WHEN dum_id IS NULL THEN '—' ELSE concat_ws(' · ', concat('DUM #', CAST(dum_id AS STRING)), CASE statut_controle WHEN 'ok' THEN 'OK' WHEN 'warning' THEN 'Attention' WHEN 'error' THEN 'Écart' END) END, CASE WHEN dum_id IS NULL THEN '—' ELSE CASE statut_controle WHEN 'ok' THEN 'Conforme' WHEN 'warning' THEN 'Attention' WHEN 'error' THEN 'Écart' ELSE '—' END END,
CASE WHEN dum_id IS NOT NULL THEN coalesce(numero_declaration_dum, d.numero_declaration, concat('DUM #', CAST(dum_id AS STRING))) END, CASE WHEN dum_id IS NOT NULL THEN coalesce(date_declaration_dum, d.date_declaration) END, CASE WHEN dum_id IS NOT NULL THEN coalesce(d.status = 'Validé', false) END,
compared_at IS NOT NULL OR statut_controle IS NOT NULL, statut_controle, montant_declare_dum, net_pay, ecart_montant, coalesce(devise_declaree_dum, devise), compared_at, dum_id, i.id, '—', i.statut = 'valide' FROM owned i LEFT JOIN hist d ON d.document_id = i.dum_id)
"""


def owned(spark, d, invoices=None):
    users = table(spark, d, "v_users").where("id % 31 <> 0").withColumns({"username": F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("username")), "email": F.when(F.col("id") % 18 != 0, F.col("email"))})
    return H.owner_labels(table(spark, d, "v_invoices") if invoices is None else invoices, table(spark, d, "v_traces"), users)


def history(spark, d):
    rows = H.history_rows(*[table(spark, d, t) for t in ("v_declarations", "v_sessions", "v_users")])
    return H.history_items(rows, owned(spark, d), corrections_per_document(*[table(spark, d, t) for t in ("v_corrections", "v_sessions", "v_users")]))


@query("jn3_owner_label", WITH + OWNED + " SELECT id, owner FROM owned")
def jn3(spark, d):
    return owned(spark, d).select("id", "owner")


@query("jn5_history_cross_link", HISTORY + "SELECT type, id, invoice_id, dum_id, partner_number, partner_date, partner_validated, reconciliation, control_label, reconciled FROM items")
def jn5(spark, d):
    return history(spark, d).select("type", "id", "invoice_id", "dum_id", "partner_number", "partner_date", "partner_validated", "reconciliation", "control_label", "reconciled")


@query("jn7_document_detail_nested", WITH + """SELECT d.id, u.username, u.email, coalesce(a.articles, '') AS articles, coalesce(t.taxes, '') AS taxes FROM v_declarations d LEFT JOIN v_users u ON u.id = d.user_id
LEFT JOIN (SELECT document_id, string_agg(concat_ws(':', place, num_ligne, code_hs, total_ligne), ',' ORDER BY place, num_ligne, code_hs, total_ligne) AS articles FROM v_articles GROUP BY 1) a ON a.document_id = d.id
LEFT JOIN (SELECT document_id, string_agg(concat_ws(':', id, code, round(quotite, 2)), ',' ORDER BY id, code, quotite) AS taxes FROM v_taxes GROUP BY 1) t ON t.document_id = d.id""")
def jn7(spark, d):
    children = {"articles": (table(spark, d, "v_articles"), "document_id", ["place", "num_ligne", "code_hs", "total_ligne"]), "taxes": (table(spark, d, "v_taxes"), "document_id", ["id", "code", "quotite"])}
    x = H.document_detail(table(spark, d, "v_declarations"), table(spark, d, "v_users"), children)
    flat = lambda c, *names: F.array_join(F.transform(c, lambda r: F.concat_ws(":", *[r[n].cast("string") for n in names])), ",").alias(c)
    return x.select("id", "uploaded_by.username", "uploaded_by.email", flat("articles", "place", "num_ligne", "code_hs", "total_ligne"), flat("taxes", "id", "code", "quotite"))


@query("jn8_unlinked_documents", WITH + """SELECT 'dum' AS kind, d.id, concat('N° déclaration ', numero) AS label, concat('Date déclaration ', coalesce(date_declaration, '—')) AS sub, '' AS linked_suffix, NOT EXISTS (SELECT 1 FROM v_invoices i WHERE i.dum_id = d.id) AS unlinked FROM v_declarations d WHERE statut = 'validated'
UNION ALL SELECT 'invoice', i.id, concat('N° facture ', i.numero), concat('Date facture ', coalesce(date_facture, '—')), CASE WHEN coalesce(d.numero, i.numero_declaration_dum) IS NULL THEN '' ELSE concat_ws(' · ', concat('liée DUM n° ', coalesce(d.numero, i.numero_declaration_dum)), d.date_declaration) END, i.dum_id IS NULL FROM v_invoices i LEFT JOIN v_declarations d ON d.id = i.dum_id WHERE i.statut = 'valide'""")
def jn8(spark, d):
    return H.pairable(table(spark, d, "v_declarations"), table(spark, d, "v_invoices"))


ASKED = "SELECT CAST(c_custkey AS BIGINT) AS position, CASE c_custkey % 9 WHEN 0 THEN 'x' WHEN 1 THEN '-5' WHEN 2 THEN concat(' ', CAST(c_custkey * 3 AS STRING), ' ') WHEN 3 THEN NULL WHEN 4 THEN '1' ELSE CAST(c_custkey AS STRING) END AS raw"
GONE = WITH + f""", asked AS (SELECT try_cast(trim(raw) AS BIGINT) AS id FROM ({ASKED} FROM customer ORDER BY position LIMIT 200)),
outcome AS (SELECT r.id, CASE WHEN d.id IS NULL THEN 'not_found' WHEN d.user_id % 5 = 2 THEN 'deleted' ELSE 'forbidden' END AS outcome FROM (SELECT DISTINCT id FROM asked WHERE id > 0) r LEFT JOIN v_declarations d ON d.id = r.id) """


def deleted(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey").alias("c")
    k = F.col("c_custkey")
    raw = F.when(k % 9 == 0, "x").when(k % 9 == 1, "-5").when(k % 9 == 2, F.concat(F.lit(" "), (k * 3).cast("string"), F.lit(" "))).when(k % 9 == 3, F.lit(None)).when(k % 9 == 4, "1").otherwise(k.cast("string"))
    mine = table(spark, d, "v_declarations").withColumn("user_id", F.col("user_id") % 5)
    return H.bulk_delete(c.select(k.cast("long").alias("position"), raw.alias("raw")), mine, 2)


@query("jn9_bulk_delete", GONE + "SELECT id, outcome FROM outcome")
def jn9(spark, d):
    return deleted(spark, d)


@query("jn9_cascade", GONE + "SELECT document_id, place FROM v_articles WHERE document_id NOT IN (SELECT id FROM outcome WHERE outcome = 'deleted')")
def jn9_cascade(spark, d):
    return H.survivors(table(spark, d, "v_articles"), deleted(spark, d), "document_id").select("document_id", "place")


@query("jn10_referential_lookup", """SELECT l.id, CASE WHEN p_partkey IS NOT NULL AND p_partkey % 10 <> 3 THEN upper(p_name) END AS importer_name FROM (SELECT l_orderkey AS id, min(l_partkey) AS code FROM lineitem GROUP BY 1) l LEFT JOIN part ON p_partkey = l.code AND p_partkey BETWEEN 100 AND 9999""")
def jn10(spark, d):
    k = F.col("p_partkey")
    # Keys as CL<n>; some entries are notes. Documents give the code with or without CL.
    entries = table(spark, d, "part").where("p_partkey between 100 and 9999").select(F.when(k % 10 == 3, F.concat(F.lit("_"), k.cast("string"))).otherwise(F.concat(F.lit("cl "), k.cast("string"))).alias("code"), F.col("p_name").alias("company"))
    codes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_partkey").alias("n"))
    docs = codes.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("CL"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string")).alias("code"))
    return H.lookup_importer(docs, entries).select("id", "importer_name")


@query("set1_unified_history", HISTORY + "SELECT * FROM items")
def set1(spark, d):
    return history(spark, d).orderBy(F.col("created_at").desc_nulls_last(), "type", "id")


STEPS = "CASE {} WHEN 1 THEN 'done,current,pending,pending,pending' WHEN 2 THEN 'done,done,current,pending,pending' WHEN 3 THEN 'done,done,done,current,pending' ELSE 'done,done,done,done,current' END"
DONE = "CASE WHEN NOT ok AND filter_key IN ('in_progress', 'pending') THEN 2 WHEN NOT ok THEN 1 WHEN control = 'ok' THEN 4 ELSE 3 END"


@query("rec8_workflow_progress", HISTORY + f"""SELECT type, id, {STEPS.format('(' + DONE + ')')} AS steps, NOT validated AS show_validation, validated AND coalesce(control, '') <> 'ok' AND (coalesce(control, '') IN ('warning', 'error') OR coalesce(partner_validated, true)) AS show_reconcile,
report AS report_invoice_id, CASE WHEN report IS NOT NULL THEN 'dossier' WHEN validated THEN type END AS export_kind FROM (SELECT *, status IN ('Validé', 'Contrôlé') OR filter_key = 'validated' AS ok, CASE WHEN control IS NOT NULL OR reconciled THEN invoice_id END AS report FROM items)""")
def rec8(spark, d):
    return H.row_actions(history(spark, d)).select("type", "id", F.array_join("steps", ",").alias("steps"), "show_validation", "show_reconcile", "report_invoice_id", "export_kind")


@query("val5_history_rows", HISTORY + "SELECT * FROM hist")
def val5(spark, d):
    return H.history_rows(*[table(spark, d, t) for t in ("v_declarations", "v_sessions", "v_users")])


@query("set1_history_totals", HISTORY + "SELECT count(*) AS total, count(*) FILTER (type = 'dum') AS dum_total, count(*) FILTER (type = 'invoice') AS invoice_total FROM items")
def set1_totals(spark, d):
    return H.history_totals(history(spark, d))


@query("flt7_history_filter", HISTORY + f"SELECT type, id, created_at FROM items WHERE filter_key IN ('in_progress', 'pending') AND created_at >= {NOW} - INTERVAL '180' DAY AND contains(lower(concat_ws(chr(10), reference, file_name, owner, reconciliation, type_label)), '#1')")
def flt7(spark, d):
    return H.filter_history(history(spark, d), F.expr(NOW), search="#1", status="in_progress", days=180).select("type", "id", "created_at")


@query("flt7_reconciled_invoices", HISTORY + "SELECT id FROM items WHERE type = 'invoice' AND reconciled")
def flt7_reconciled(spark, d):
    return H.filter_history(history(spark, d), F.expr(NOW), type="invoice", status="reconciled").select("id")


AT = "coalesce(strftime({0}, '%d/%m/%Y %H:%M'), '—')"
CSV = f"""SELECT type_label AS "Type", reference AS "Référence", file_name AS "Fichier", coalesce(owner, '') AS "Propriétaire", {AT.format('created_at')} AS "Date", status AS "Statut", reconciliation AS "Réconciliation", coalesce(control, '—') AS "Statut contrôle", coalesce(CAST(pfn AS STRING), '—') AS "PFN DUM", coalesce(CAST(net_pay AS STRING), '—') AS "NET PAY",
coalesce(CAST(gap AS STRING), '—') AS "Écart montant", coalesce(currency, '—') AS "Devise contrôle", {AT.format('compared_at')} AS "Date comparaison", coalesce(CAST(dum_id AS STRING), '—') AS "ID DUM", coalesce(CAST(invoice_id AS STRING), '—') AS "ID Facture", corrections AS "Corrections" FROM items"""


@query("src6_history_lines", HISTORY + CSV)
def src6(spark, d):
    return H.history_lines(history(spark, d)).select(H.HISTORY_HEADINGS)


@query("src7_control_lines", HISTORY + f'SELECT * EXCLUDE ("Propriétaire", "Corrections") FROM ({CSV})')
def src7(spark, d):
    return H.history_lines(history(spark, d)).select(H.CONTROL_HEADINGS)


@query("set3_article_dedupe", WITH + "SELECT document_id AS doc, num_ligne, code_hs, min(place) AS place FROM v_articles GROUP BY ALL")
def set3(spark, d):
    return H.article_dedupe(table(spark, d, "v_articles").withColumnRenamed("document_id", "doc")).select("doc", "num_ligne", "code_hs", "place")


@query("set3_article_dedupe_by_value", WITH + "SELECT document_id AS doc, num_ligne, code_hs, total_ligne, min(place) AS place FROM v_articles GROUP BY ALL")
def set3_value(spark, d):
    return H.article_dedupe(table(spark, d, "v_articles").withColumnRenamed("document_id", "doc"), by_value=True).select("doc", "num_ligne", "code_hs", "total_ligne", "place")
