"""Links, reconciliation, gates and payloads."""

from pyspark.sql import functions as F

from docrecon.functions.scalars import dum_validated, invoice_validated
from docrecon.operators.core import CONTROL, amount_aligned, anomaly_rows, compare_inputs, link_one_to_one, reconcile, resolved_status
from docrecon.operators.quality import coherence
from docrecon.operators.workflow import EXTRACTED, export_gate, export_payloads, export_target, fields_to_long, migration_log
from docrecon.plans.aggregates import RESOLVED
from docrecon.registry import query
from docrecon.sources.tables import NOW, WITH, table

CLEARED = ", ".join(f"CASE WHEN keep THEN {c} END AS {c}" for c in ["dum_id", *CONTROL])
REC = f""", given AS (SELECT id AS dum_id, CASE WHEN id % 86 = 0 THEN 100.0 END AS pfn, CASE WHEN id % 43 = 0 AND id % 3 = 0 THEN 250.5 END AS declared, CASE WHEN id % 47 = 0 THEN 'GBP' WHEN id % 2 = 0 THEN '  ' END AS devise FROM v_declarations),
inputs AS (SELECT id AS dum_id, numero AS dum_numero, statut AS dum_statut, coalesce(g.pfn, CAST(replace(montant_ptfn, ',', '.') AS DOUBLE), g.declared) AS pfn, coalesce(nullif(trim(g.devise), ''), d.devise) AS dum_devise, CAST(nombre_colis AS INT) AS dum_colis, CAST(poids_net AS DOUBLE) AS dum_poids, mode_livraison AS dum_mode FROM v_declarations d JOIN given g ON g.dum_id = d.id),
linked AS (SELECT * EXCLUDE (keep) REPLACE ({CLEARED}) FROM (SELECT *, dum_id IS NULL OR row_number() OVER (PARTITION BY dum_id ORDER BY created_at DESC, id DESC) = 1 AS keep FROM v_invoices)),
j AS (SELECT *, coalesce(net_pay, montant_ttc) AS base, CASE WHEN coalesce(net_pay, montant_ttc) IS NULL OR pfn IS NULL THEN 0.0 ELSE round(coalesce(net_pay, montant_ttc) - pfn, 4) END AS gap FROM linked LEFT JOIN inputs USING (dum_id)),
k AS (SELECT *, base IS NOT NULL AND pfn IS NOT NULL AS usable, coalesce(devise <> dum_devise, false) AS cur, abs(gap) > 0.01 AS off, abs(gap) > 1.0 AS severe, coalesce(nombre_colis <> dum_colis, false) AS pk, coalesce(abs(poids_net - dum_poids) > 0.5, false) AS wt, coalesce(mode_livraison <> dum_mode, false) AS md,
printf('%+.4f', gap) AS signed, concat('Devises différentes : facture=', devise, ', DUM=', dum_devise, ' — vérifiez la comparaison.') AS differ FROM j),
rec AS (SELECT *, CASE WHEN NOT usable OR off AND severe THEN 'error' WHEN off OR cur OR pk OR wt OR md THEN 'warning' ELSE 'ok' END AS status,
CASE WHEN base IS NULL THEN 'Montant facture manquant' WHEN pfn IS NULL THEN 'Montant DUM manquant' WHEN off THEN concat('Écart montant ', signed, ' (facture − DUM PFN).') WHEN cur THEN differ ELSE 'OK — NET PAY facture aligné avec PFN article DUM (tolérance respectée).' END AS comment FROM k),
an AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) - 1 AS position FROM (
SELECT id, 1 AS o, 'invoice_amount_missing' AS code, 'error' AS severity, 'Aucun NET PAY (ni TTC) sur la facture pour comparer.' AS message, NULL AS facture_value, CAST(pfn AS STRING) AS dum_value FROM rec WHERE base IS NULL
UNION ALL SELECT id, 2, 'dum_pfn_missing', 'error', 'PFN article / montant PTFN DUM non fourni.', CAST(base AS STRING), NULL FROM rec WHERE base IS NOT NULL AND pfn IS NULL
UNION ALL SELECT id, 3, 'currency_mismatch', 'warning', differ, devise, dum_devise FROM rec WHERE usable AND cur
UNION ALL SELECT id, 4, 'montant_net_pay_vs_pfn', 'info', 'Comparaison principale : NET PAY (facture) vs PFN article (DUM).', concat_ws(' ', CAST(base AS STRING), devise), concat_ws(' ', CAST(pfn AS STRING), dum_devise) FROM rec WHERE usable
UNION ALL SELECT id, 5, 'amount_gap', CASE WHEN severe THEN 'error' ELSE 'warning' END, concat('Écart montant ', signed, ' (facture − DUM PFN).'), CAST(base AS STRING), CAST(pfn AS STRING) FROM rec WHERE usable AND off
UNION ALL SELECT id, 6, 'amount_ok', 'info', concat('Écart ', signed, ' dans la tolérance ±0.01.'), CAST(base AS STRING), CAST(pfn AS STRING) FROM rec WHERE usable AND NOT off AND NOT cur
UNION ALL SELECT id, 7, 'colis_mismatch', 'warning', 'Nombre de colis différent.', CAST(nombre_colis AS STRING), CAST(dum_colis AS STRING) FROM rec WHERE usable AND pk
UNION ALL SELECT id, 8, 'poids_net_mismatch', 'warning', 'Poids net (kg) différent.', CAST(poids_net AS STRING), CAST(dum_poids AS STRING) FROM rec WHERE usable AND wt
UNION ALL SELECT id, 9, 'incoterm_mismatch', 'warning', 'Incoterm / mode livraison différent.', mode_livraison, dum_mode FROM rec WHERE usable AND md
UNION ALL SELECT id, 10, 'declaration_linked', 'info', concat('Déclaration DUM n° ', dum_numero, '.'), NULL, dum_numero FROM rec WHERE usable))
"""
ALIGNED = "status <> 'error' AND NOT (usable AND off) AND CASE WHEN net_pay IS NOT NULL AND pfn IS NOT NULL THEN abs(net_pay - pfn) <= 0.01 WHEN ecart_montant IS NOT NULL THEN abs(ecart_montant) <= 0.01 ELSE status = 'ok' END"


def inputs(spark, d):
    dums = table(spark, d, "v_declarations")
    given = dums.selectExpr("id AS dum_id", "CASE WHEN id % 86 = 0 THEN 100.0D END AS pfn", "CASE WHEN id % 43 = 0 AND id % 3 = 0 THEN 250.5D END AS declared", "CASE WHEN id % 47 = 0 THEN 'GBP' WHEN id % 2 = 0 THEN '  ' END AS devise")
    return compare_inputs(dums, given)


def reconciled(spark, d):
    return reconcile(link_one_to_one(table(spark, d, "v_invoices")), inputs(spark, d))


@query("rec1_compare_inputs", WITH + REC + "SELECT dum_id, pfn, dum_devise, dum_colis, dum_poids, dum_mode FROM inputs")
def rec1(spark, d):
    return inputs(spark, d).select("dum_id", "pfn", "dum_devise", "dum_colis", "dum_poids", "dum_mode")


@query("rec2_link_one_to_one", WITH + REC + f"SELECT id, dum_id, {', '.join(CONTROL)} FROM linked")
def rec2(spark, d):
    return link_one_to_one(table(spark, d, "v_invoices")).select("id", "dum_id", *CONTROL)


@query("rec_compare", WITH + REC + "SELECT id, dum_id, gap, status, comment, codes FROM rec LEFT JOIN (SELECT id, string_agg(code, ',' ORDER BY o) AS codes FROM an GROUP BY 1) USING (id)")
def rec3(spark, d):
    return reconciled(spark, d).select("id", "dum_id", "gap", "status", "comment", F.array_join("codes", ",").alias("codes"))


@query("rec3_anomalies", WITH + REC + "SELECT id, position, code, severity, message, facture_value, dum_value FROM an")
def rec3_rows(spark, d):
    return anomaly_rows(reconciled(spark, d)).withColumn("position", F.col("position").cast("long"))


@query("rec4_reconcile_gate", WITH + REC + """SELECT id, CASE WHEN statut <> 'valide' THEN 'invoice_not_validated' WHEN dum_numero IS NULL THEN 'declaration_missing' WHEN pfn IS NULL THEN 'pfn_missing' WHEN dum_statut <> 'validated' THEN 'declaration_not_validated' END AS reject_reason,
CASE status WHEN 'ok' THEN 'controle_ok' WHEN 'warning' THEN 'controle_warning' ELSE 'controle_ecart' END AS new_status FROM rec""")
def rec4(spark, d):
    reason = F.when(~invoice_validated(F.col("statut")), "invoice_not_validated").when(F.col("dum_numero").isNull(), "declaration_missing").when(F.col("pfn").isNull(), "pfn_missing").when(~dum_validated(F.col("dum_statut")), "declaration_not_validated")
    status = F.when(F.col("status") == "ok", "controle_ok").when(F.col("status") == "warning", "controle_warning").otherwise("controle_ecart")
    return reconciled(spark, d).select("id", reason.alias("reject_reason"), status.alias("new_status"))


@query("rec5_anomaly_rows", WITH + REC + "SELECT code, severity, count(*) AS n FROM an GROUP BY ALL")
def rec5(spark, d):
    return anomaly_rows(reconciled(spark, d)).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query("rec6_amount_aligned", WITH + REC + f"SELECT id, {ALIGNED} AS aligned FROM rec")
def rec6(spark, d):
    r = reconciled(spark, d)
    return r.select("id", amount_aligned(r).alias("aligned"))


@query("agg6_report_stats", WITH + REC + "SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'error') AS error FROM rec")
def agg6(spark, d):
    return reconciled(spark, d).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warning", "error")])


@query("erp3_export_gate", WITH + REC + f"""SELECT id, kind, CASE WHEN kind = 'dossier' AND NOT aligned THEN 'refused' WHEN kind = 'dossier' AND status = 'error' AND NOT admin THEN 'admin_only' WHEN kind = 'dossier' AND status = 'error' THEN 'confirm_critical' WHEN kind = 'dossier' AND status = 'warning' THEN 'confirm_attention' ELSE 'confirm' END AS gate
FROM (SELECT id, status, id % 2 = 0 AS admin, {ALIGNED} AS aligned, CASE WHEN dum_id IS NOT NULL THEN 'dossier' WHEN statut = 'valide' THEN 'invoice' END AS kind FROM rec)""")
def erp3(spark, d):
    r = reconciled(spark, d)
    kind = export_target(F.col("dum_id").isNotNull(), F.lit(False), invoice_validated(F.col("statut")))
    return r.select("id", kind.alias("kind"), export_gate(kind, F.col("status"), amount_aligned(r), F.col("id") % 2 == 0).alias("gate"))


@query("erp2_export_payload", WITH + REC + """SELECT r.id, json_object('schema_version', '1.0', 'kind', 'dossier', 'reference', r.numero, 'exported_at', '2024-02-15T00:00:00Z', 'exported_by', json_object('user_id', u.id, 'username', u.username, 'role', u.role),
'dum', CASE WHEN d.id IS NOT NULL THEN json_object('id', d.id, 'numero', d.numero, 'statut', d.statut, 'devise', d.devise, 'montant_ptfn', d.montant_ptfn, 'nombre_colis', d.nombre_colis, 'poids_net', d.poids_net, 'mode_livraison', d.mode_livraison) END,
'invoice', json_object('id', r.id, 'numero', r.numero, 'devise', r.devise, 'net_pay', r.net_pay, 'montant_ttc', r.montant_ttc),
'controle', json_object('statut_controle', r.statut_controle, 'ecart_montant', r.ecart_montant, 'ecart_commentaire', r.ecart_commentaire, 'montant_declare_dum', r.montant_declare_dum, 'numero_declaration_dum', r.numero_declaration_dum, 'date_declaration_dum', r.date_declaration_dum))::STRING AS payload_json
FROM linked r LEFT JOIN v_declarations d ON d.id = r.dum_id LEFT JOIN v_users u ON u.id = r.user_id""")
def erp2(spark, d):
    users = table(spark, d, "v_users").select(F.col("id").alias("user_id"), F.struct(F.col("id").alias("user_id"), "username", "role").alias("exported_by"))
    dums = table(spark, d, "v_declarations").select("id", "numero", "statut", "devise", "montant_ptfn", "nombre_colis", "poids_net", "mode_livraison")
    out = export_payloads(link_one_to_one(table(spark, d, "v_invoices")), dums, users, "2024-02-15T00:00:00Z", ["id", "numero", "devise", "net_pay", "montant_ttc"])
    return out.select("id", "payload_json")


# Exports: some without payload, some without a reference of their own.
EXPORTS = "SELECT id AS export_id, CASE id % 3 WHEN 0 THEN 'dum' WHEN 1 THEN 'invoice' END AS kind, CASE WHEN id % 5 = 0 THEN numero END AS reference, CASE WHEN id % 7 = 0 THEN '' ELSE 'x' END AS payload, CASE WHEN id % 2 = 0 THEN concat('P', numero) END AS payload_reference FROM v_invoices"


@query("erp4_migration_log", WITH + f"""SELECT export_id, payload <> '' AS success, CASE WHEN payload <> '' THEN concat('ERP-', upper(coalesce(kind, 'dossier')), '-', CAST(export_id AS STRING), '-20240215') END AS erp_reference,
CASE WHEN payload = '' THEN 'Payload ERP vide.' ELSE concat('Migration ERP simulée réussie (', coalesce(reference, payload_reference, concat('EXP-', CAST(export_id AS STRING))), ').') END AS message, CASE WHEN payload <> '' THEN 'migration_ok' ELSE 'migration_failed' END AS status FROM ({EXPORTS})""")
def erp4(spark, d):
    i = table(spark, d, "v_invoices")
    k = F.col("id")
    exports = i.select(k.alias("export_id"), F.when(k % 3 == 0, "dum").when(k % 3 == 1, "invoice").alias("kind"), F.when(k % 5 == 0, F.col("numero")).alias("reference"), F.when(k % 7 == 0, "").otherwise("x").alias("payload"), F.when(k % 2 == 0, F.concat(F.lit("P"), "numero")).alias("payload_reference"))
    return migration_log(exports, F.expr(NOW), "ERP").select("export_id", "success", "erp_reference", "message", "status")


@query("val4_resolved_status", WITH + RESOLVED + "SELECT id, resolved AS status, CASE resolved WHEN 'validated' THEN 'success' WHEN 'rejected' THEN 'danger' WHEN 'pending' THEN 'neutral' ELSE 'info' END AS tone FROM resolved")
def val4(spark, d):
    r = F.col("resolved")
    return resolved_status(table(spark, d, "v_declarations"), table(spark, d, "v_sessions")).select("id", r.alias("status"), F.when(r == "validated", "success").when(r == "rejected", "danger").when(r == "pending", "neutral").otherwise("info").alias("tone"))


KEYS = ["numero", "statut", "devise", "montant_ptfn", "nombre_colis", "poids_brut", "poids_net", "mode_livraison", "date_declaration", "fichier", "nbre_articles"]


@query("val1_fields_to_long", WITH + " UNION ALL ".join(f"SELECT id, '{k}' AS field_key, trim({k}) AS value FROM v_declarations WHERE trim({k}) <> ''" for k in KEYS if k in EXTRACTED) + " UNION ALL SELECT id, 'numero_declaration', numero FROM v_declarations UNION ALL SELECT id, 'score_confiance', CAST(score_confiance AS STRING) FROM v_declarations")
def val1(spark, d):
    return fields_to_long(table(spark, d, "v_declarations").withColumn("numero_declaration", F.col("numero")))


@query("qlt3_cross_field_coherence", WITH + """, c AS (SELECT id, CAST(poids_brut AS DOUBLE) AS b, CAST(poids_net AS DOUBLE) AS n, CAST(nombre_colis AS DOUBLE) * 3 AS p, CAST(nbre_articles AS DOUBLE) AS a FROM v_declarations), w AS (SELECT *, b + 0.000001 < n AS x, p > 0 AND a > 0 AND p > a * 50 AS y FROM c)
SELECT id, concat_ws(';', CASE WHEN x THEN concat('poids_brut_lt_poids_net:', CAST(b AS STRING), ':', CAST(n AS STRING)) END, CASE WHEN y THEN concat('colis_vs_nb_articles_suspicious:', CAST(CAST(p AS INT) AS STRING), ':', CAST(CAST(a AS INT) AS STRING)) END) AS warnings,
concat_ws(',', CASE WHEN y THEN 'colis_articles_ratio_suspicious' END, CASE WHEN x THEN 'poids_cross_field_inconsistent' END) AS reasons, concat_ws(',', CASE WHEN y THEN 'cross_field_logistics_suspicious' END, CASE WHEN x THEN 'cross_field_weight_inconsistency' END, 'seen') AS flags FROM w""")
def qlt3(spark, d):
    dums = table(spark, d, "v_declarations").withColumns({"nombre_colis": (F.col("nombre_colis").cast("int") * 3).cast("string"), "flags": F.array(F.lit("seen"))})
    told = F.transform("warnings", lambda w: F.concat_ws(":", w["rule"], w["first"], w["second"]))
    return coherence(dums).select("id", F.array_join(told, ";").alias("warnings"), F.array_join("reasons", ",").alias("reasons"), F.array_join("flags", ",").alias("flags"))
