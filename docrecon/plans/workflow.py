"""Validation, history, comparison tables, reports and scores of documents."""

from pyspark.sql import functions as F

from docrecon.functions.scalars import dum_validated, filled, parse_amount
from docrecon.operators.core import latest_sessions, link_one_to_one, resolved_status
from docrecon.operators.workflow import apply_corrections, comparison_rows, corrected_documents, diff_fields, field_confidences, issues_of, mean_confidence, patch_columns, patch_lines, score_declaration
from docrecon.plans.aggregates import RESOLVED
from docrecon.plans.reconciliation import REC, reconciled
from docrecon.registry import query
from docrecon.sources.tables import over, WITH, table

# What a user submits for a declaration: some values edited, some cleared, some filled in.
SUBMITTED = {
    "nombre_colis": "CASE WHEN id % 7 = 0 THEN '' WHEN id % 5 = 0 THEN concat(nombre_colis, '0') ELSE concat(' ', nombre_colis) END",
    "devise": "CASE WHEN id % 31 = 0 THEN 'EUR' WHEN id % 11 = 0 THEN NULL ELSE devise END",
    "mode_livraison": "CASE WHEN id % 13 = 0 THEN 'FCA' ELSE mode_livraison END",
}
STORED_SQL = " UNION ALL ".join(f"SELECT id, '{k}' AS field_key, {k} AS value FROM v_declarations" for k in SUBMITTED)
GIVEN_SQL = " UNION ALL ".join(f"SELECT id, '{k}' AS field_key, {e} AS value FROM v_declarations" for k, e in SUBMITTED.items())
DIFF = f""", stored AS ({STORED_SQL}), given AS ({GIVEN_SQL}), changed AS (SELECT id, field_key, s.value AS old_value, g.value AS new_value,
CASE WHEN coalesce(trim(s.value), '') = '' THEN 'add' WHEN trim(g.value) = '' THEN 'delete' ELSE 'update' END AS action_type
FROM given g JOIN stored s USING (id, field_key) WHERE g.value IS NOT NULL AND coalesce(trim(s.value), '') <> trim(g.value)) """


def stored(spark, d):
    return table(spark, d, "v_declarations").select("id", *SUBMITTED).unpivot("id", list(SUBMITTED), "field_key", "value")


def submitted(spark, d):
    given = table(spark, d, "v_declarations").selectExpr("id", *[f"{e} AS {k}" for k, e in SUBMITTED.items()])
    return given.unpivot("id", list(SUBMITTED), "field_key", "value")


@query("val2_diff_corrections", WITH + DIFF + "SELECT id, field_key, old_value, new_value, action_type FROM changed")
def val2(spark, d):
    return diff_fields(stored(spark, d), submitted(spark, d))


@query("val3_apply_corrections", WITH + DIFF + "SELECT id, field_key, coalesce(c.new_value, s.value) AS value, coalesce(c.action_type = 'add', false) AS manually_added FROM stored s LEFT JOIN changed c USING (id, field_key) WHERE coalesce(trim(s.value), '') <> '' OR c.new_value IS NOT NULL")
def val3(spark, d):
    kept = stored(spark, d).where(filled(F.col("value")).isNotNull())
    return apply_corrections(kept, diff_fields(stored(spark, d), submitted(spark, d)))


@query("val3_corrected_documents", WITH + DIFF + """SELECT d.id, coalesce(c.n, 0) AS corrections, CASE WHEN c.n IS NULL THEN d.statut WHEN d.id % 2 = 0 THEN 'validated' WHEN d.id % 3 = 0 THEN 'rejected' ELSE 'processing' END AS statut, concat('{', coalesce(c.raw, ''), '}') AS raw_json FROM v_declarations d
LEFT JOIN (SELECT id, count(*) AS n, string_agg(concat('"', field_key, '":"', new_value, '"'), ',' ORDER BY field_key) AS raw FROM changed GROUP BY 1) c ON c.id = d.id""")
def val3_documents(spark, d):
    changes = diff_fields(stored(spark, d), submitted(spark, d))
    k = F.col("id")
    said = changes.select("id").distinct().withColumn("status", F.when(k % 2 == 0, " Valide").when(k % 3 == 0, "REJETE").otherwise("inprogress"))
    dums = table(spark, d, "v_declarations").select("id", "statut", F.lit("{}").alias("raw_json"))
    return corrected_documents(dums, changes, said).select("id", "corrections", "statut", "raw_json")


@query("val6_patch_invoices", WITH + """, new AS (SELECT invoice_id, line_order, quantite * 2 AS quantite, montant_ligne FROM v_lines WHERE invoice_id % 10 = 3 AND line_order <= 2)
SELECT invoice_id, line_order, quantite, montant_ligne FROM v_lines WHERE invoice_id NOT IN (SELECT invoice_id FROM new) UNION ALL SELECT * FROM new""")
def val6(spark, d):
    lines = table(spark, d, "v_lines")
    new = lines.where("invoice_id % 10 = 3 and line_order <= 2").withColumn("quantite", F.col("quantite") * 2)
    return patch_lines(lines, new)


@query("val6_patch_headers", WITH + "SELECT id, CASE WHEN id % 10 = 3 THEN 'CHF' WHEN id % 10 = 4 THEN NULL ELSE devise END AS devise, CASE WHEN id % 10 = 4 THEN 1.5 ELSE net_pay END AS net_pay, numero FROM v_invoices")
def val6_headers(spark, d):
    # One patch sets a currency, the other clears it and sets the amount; columns that aren't named stay.
    k = F.col("id")
    some = table(spark, d, "v_invoices").where("id % 10 in (3, 4)")
    patches = some.select("id", F.when(k % 10 == 3, F.array(F.lit("devise"))).otherwise(F.array(F.lit("devise"), F.lit("net_pay"))).alias("provided"), F.when(k % 10 == 3, "CHF").alias("devise"), F.when(k % 10 == 4, 1.5).alias("net_pay"))
    return patch_columns(table(spark, d, "v_invoices"), patches).select("id", "devise", "net_pay", "numero")


@query("rec7_comparison_table", WITH + REC + """, c AS (SELECT * FROM rec)
SELECT id, 'montant_net_pay_vs_pfn' AS code, 1 AS position, CASE WHEN usable AND status <> 'error' AND NOT off THEN 'ok' WHEN usable AND off AND severe THEN 'error' ELSE 'warning' END AS tone FROM c
UNION ALL SELECT id, 'currency_mismatch', 2, CASE WHEN cur THEN 'warning' ELSE 'ok' END FROM c
UNION ALL SELECT id, 'colis_mismatch', 3, CASE WHEN usable AND pk THEN 'warning' WHEN nombre_colis IS NULL OR dum_colis IS NULL THEN 'neutral' WHEN nombre_colis = dum_colis THEN 'ok' ELSE 'warning' END FROM c
UNION ALL SELECT id, 'poids_net_mismatch', 4, CASE WHEN usable AND wt THEN 'warning' WHEN poids_net IS NULL OR dum_poids IS NULL THEN 'neutral' WHEN abs(poids_net - dum_poids) < 0.01 THEN 'ok' ELSE 'warning' END FROM c
UNION ALL SELECT id, 'incoterm_mismatch', 5, CASE WHEN usable AND md THEN 'warning' WHEN mode_livraison IS NULL OR dum_mode IS NULL THEN 'neutral' WHEN mode_livraison = dum_mode THEN 'ok' ELSE 'warning' END FROM c
UNION ALL SELECT id, 'declaration_number', 6, CASE WHEN dum_numero IS NULL THEN 'neutral' ELSE 'ok' END FROM c
UNION ALL SELECT id, 'declaration_date', 7, CASE WHEN dum_id IS NULL THEN 'neutral' ELSE 'ok' END FROM c
UNION ALL SELECT id, 'invoice_number', 8, CASE WHEN numero IS NULL THEN 'neutral' ELSE 'ok' END FROM c
UNION ALL SELECT id, 'invoice_date', 9, CASE WHEN created_at IS NULL THEN 'neutral' ELSE 'ok' END FROM c""")
def rec7(spark, d):
    return comparison_rows(with_dates(spark, d)).select("id", "code", "position", "tone")


def with_dates(spark, d):
    dates = table(spark, d, "v_declarations").select(F.col("id").alias("dum_id"), F.col("created_at").alias("dum_date"))
    return reconciled(spark, d).join(dates, "dum_id", "left")


@query("rec9_dossier_report", WITH + REC + """, c AS (SELECT id, dum_id, status, gap, usable AND status <> 'error' AND NOT off AS aligned,
CASE WHEN usable AND status <> 'error' AND NOT off THEN 0 ELSE 1 END + CASE WHEN cur THEN 1 ELSE 0 END + CASE WHEN nombre_colis <> dum_colis THEN 1 ELSE 0 END
+ CASE WHEN usable AND wt OR abs(poids_net - dum_poids) >= 0.01 THEN 1 ELSE 0 END + CASE WHEN mode_livraison <> dum_mode THEN 1 ELSE 0 END AS issues FROM rec)
SELECT id, dum_id, status, gap, aligned, issues, status = 'ok' AND aligned AND issues = 0 AS conforme FROM c""")
def rec9(spark, d):
    r = issues_of(with_dates(spark, d))
    return r.select("id", "dum_id", "status", "gap", "aligned", "issues", ((F.col("status") == "ok") & F.col("aligned") & (F.col("issues") == 0)).alias("conforme"))


@query("erp1_export_request_check", WITH + """, q AS (SELECT id, CASE id % 4 WHEN 0 THEN ' DUM ' WHEN 1 THEN 'invoice' WHEN 2 THEN 'Dossier' ELSE 'other' END AS kind, dum_id, CASE WHEN id % 6 = 1 THEN NULL ELSE id END AS invoice_id FROM v_invoices)
SELECT id, CASE WHEN lower(trim(kind)) NOT IN ('dum', 'invoice', 'dossier') THEN 'kind_unknown' WHEN lower(trim(kind)) = 'dum' AND coalesce(dum_id, 0) = 0 THEN 'dum_required' WHEN lower(trim(kind)) = 'invoice' AND coalesce(invoice_id, 0) = 0 THEN 'invoice_required'
WHEN lower(trim(kind)) = 'dossier' AND (coalesce(dum_id, 0) = 0 OR coalesce(invoice_id, 0) = 0) THEN 'both_required' END AS reason FROM q""")
def erp1(spark, d):
    asked = F.when(F.col("id") % 4 == 0, " DUM ").when(F.col("id") % 4 == 1, "invoice").when(F.col("id") % 4 == 2, "Dossier").otherwise("other")
    q = table(spark, d, "v_invoices").select("id", F.lower(F.trim(asked)).alias("kind"), "dum_id", F.when(F.col("id") % 6 != 1, F.col("id")).alias("invoice_id"))
    no = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    kind = F.col("kind")
    reason = F.when(~kind.isin("dum", "invoice", "dossier"), "kind_unknown").when((kind == "dum") & no("dum_id"), "dum_required").when((kind == "invoice") & no("invoice_id"), "invoice_required").when((kind == "dossier") & (no("dum_id") | no("invoice_id")), "both_required")
    return q.select("id", reason.alias("reason"))


# A declaration's header with the fields that the score looks at.
HEADER = """SELECT d.id, CASE WHEN d.id % 10 = 1 THEN concat(d.numero, 'X') ELSE d.numero END AS number, CASE WHEN d.id % 9 = 0 THEN NULL ELSE date_text END AS date, CASE d.id % 4 WHEN 0 THEN 'I.M 4' WHEN 1 THEN 'EA' WHEN 2 THEN 'ex1' ELSE 'ZZ' END AS type, d.devise AS currency,
CASE WHEN d.id % 8 = 0 THEN 'AB 12' ELSE u.username END AS exporter, CASE WHEN d.id % 12 = 0 THEN ' AB ' ELSE u.username END AS importer, d.poids_brut AS gross, d.poids_net AS net, CASE WHEN d.id % 6 = 0 THEN '' ELSE '12' END AS office,
CASE WHEN d.id % 5 = 0 THEN 'D2024AB1C' ELSE 'none' END AS auth_key, CASE WHEN d.id % 3 = 0 THEN '602' END AS duty_code, CASE d.id % 3 WHEN 0 THEN '13,5' WHEN 1 THEN 'x' END AS duty_total, d.score_confiance FROM (SELECT *, {date} AS date_text FROM v_declarations) d LEFT JOIN v_users u ON u.id = d.user_id"""


def header(spark, d):
    return over(spark, d, HEADER.format(date="date_format(created_at, 'dd/MM/yyyy')"), "v_declarations", "v_users")


QLT1 = """, h AS (""" + HEADER.format(date="strftime(created_at, '%d/%m/%Y')") + """), c AS (SELECT *, coalesce(regexp_full_match(number, '[0-9]{6}'), false) AS a, coalesce(regexp_matches(date, '[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4}'), false) AS b,
replace(replace(upper(type), '.', ''), ' ', '') IN ('DAE','EA','SE','EE','DUM','IM','IM4','IM6','EX','EX1','EX3','T1') AS t, coalesce(currency, '') IN ('', 'USD','EUR','GBP','TND','CHF','JPY','CAD') AS cu, length(regexp_replace(coalesce(exporter, ''), '[^A-Za-z]', '', 'g')) >= 5 AS e,
length(trim(coalesce(importer, ''))) >= 5 AS i, CAST(gross AS DOUBLE) >= CAST(net AS DOUBLE) AS w, office <> '' AS o, regexp_full_match(auth_key, 'D[0-9]{2,6}[A-Z]{2,4}[0-9][A-Z]') AS k FROM h),
p AS (SELECT *, CAST(round_even((CASE WHEN a THEN 3 ELSE 0 END + CASE WHEN b THEN 2 ELSE 0 END + CASE WHEN t THEN 2 ELSE 0 END + CASE WHEN cu THEN 2 ELSE 0 END + CASE WHEN e THEN 2 ELSE 0 END + CASE WHEN i THEN 2 ELSE 0 END + CASE WHEN w THEN 1 ELSE 0 END + CASE WHEN o THEN 1 ELSE 0 END + CASE WHEN k THEN 1 ELSE 0 END) * 100.0 / 16, 0) AS INT) AS score FROM c)
SELECT id, score, CASE WHEN score >= 80 THEN 'HAUT' WHEN score >= 50 THEN 'MOYEN' ELSE 'BAS' END AS quality, concat_ws(',', CASE WHEN NOT a THEN 'number' END, CASE WHEN NOT b THEN 'date' END, CASE WHEN NOT t THEN 'type' END, CASE WHEN NOT cu THEN 'currency' END, CASE WHEN NOT e THEN 'exporter' END,
CASE WHEN NOT i THEN 'importer' END, CASE WHEN NOT w THEN 'weights' END, CASE WHEN NOT o THEN 'office' END, CASE WHEN NOT k THEN 'auth_key' END) AS flags FROM p"""


@query("qlt1_score_declaration", WITH + QLT1)
def qlt1(spark, d):
    return score_declaration(header(spark, d)).select("id", "score", "quality", F.array_join("flags", ",").alias("flags"))


CONFIDENCE = WITH + ", h AS (" + HEADER.format(date="strftime(created_at, '%d/%m/%Y')") + """), c AS (SELECT id, CASE WHEN coalesce(number, '') = '' THEN 0 WHEN regexp_full_match(number, '[0-9]{6}') THEN 95 ELSE 35 END AS number, CASE WHEN coalesce(date, '') = '' THEN 0 WHEN regexp_full_match(date, '[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}') THEN 90 ELSE 45 END AS date,
CASE WHEN regexp_full_match(upper(type), '(EA|SE|EE|DUM|IM[0-9]*|EX[0-9]*|T1)') THEN 88 ELSE 40 END AS type, CASE WHEN trim(coalesce(importer, '')) = '' THEN 0 WHEN length(regexp_replace(importer, '[^A-Za-z]', '', 'g')) >= 6 THEN 78 ELSE 45 END AS importer, 80 AS gross, 80 AS net,
CASE WHEN regexp_full_match(auth_key, 'D[0-9]{2,6}[A-Z]{2,4}[0-9][A-Z]') THEN 92 ELSE 35 END AS auth_key, CASE WHEN duty_code IS NULL THEN 0 ELSE 65 END AS duty_code, CASE WHEN duty_total IS NULL THEN 0 WHEN duty_total = 'x' THEN 50 ELSE 80 END AS duty_total, score_confiance FROM h) """


@query("qlt2_field_confidences", CONFIDENCE + "SELECT id, number, date, type, importer, gross, net, auth_key, duty_code, duty_total FROM c")
def qlt2(spark, d):
    return field_confidences(header(spark, d)).select("id", *[F.col("confidence")[k].alias(k) for k in ("number", "date", "type", "importer", "gross", "net", "auth_key", "duty_code", "duty_total")])


NINE = "(number + date + type + importer + gross + net + auth_key + duty_code + duty_total) / 9.0"


@query("agg15_mean_field_confidence", CONFIDENCE + f"SELECT id, CASE WHEN id % 14 = 0 THEN score_confiance ELSE {NINE} END AS mean, CASE WHEN id % 14 = 0 THEN score_confiance ELSE CAST(floor({NINE} + 0.5) AS INT) END AS rounded FROM c")
def agg15(spark, d):
    # Some documents have no confidences at all; their own score stands in.
    docs = field_confidences(header(spark, d)).withColumn("confidence", F.when(F.col("id") % 14 != 0, F.col("confidence")))
    return docs.select("id", *[c.alias(k) for k, c in mean_confidence(F.col("confidence"), F.col("score_confiance")).items()])


@query("jn4_dum_meta_fill", WITH + "SELECT i.id, coalesce(CASE WHEN i.id % 2 = 0 THEN concat('N', i.numero) END, d.numero) AS dum_numero, d.created_at AS dum_date FROM v_invoices i LEFT JOIN v_declarations d ON d.id = i.dum_id")
def jn4(spark, d):
    own = F.when(F.col("id") % 2 == 0, F.concat(F.lit("N"), F.col("numero")))
    dums = table(spark, d, "v_declarations").select(F.col("id").alias("dum_id"), F.col("numero").alias("linked"), F.col("created_at").alias("dum_date"))
    return table(spark, d, "v_invoices").join(dums, "dum_id", "left").select("id", F.coalesce(own, F.col("linked")).alias("dum_numero"), "dum_date")


@query("jn6_invoice_by_dum", WITH + REC + "SELECT d.id, l.id AS invoice_id, l.net_pay FROM v_declarations d LEFT JOIN linked l ON l.dum_id = d.id")
def jn6(spark, d):
    linked = link_one_to_one(table(spark, d, "v_invoices")).where("dum_id is not null").select(F.col("dum_id").alias("id"), F.col("id").alias("invoice_id"), "net_pay")
    return table(spark, d, "v_declarations").select("id").join(linked, "id", "left")


@query("agg14_article_count_sync", WITH + """, l AS (SELECT invoice_id AS id, count(*) AS n, arg_min(quantite, struct_pack(o := line_order, m := montant_ligne)) AS first_quantity FROM v_lines GROUP BY 1)
SELECT d.id, CASE WHEN l.n > 1 AND l.n > CAST(d.nombre_colis AS INT) % 6 THEN l.n ELSE CAST(d.nombre_colis AS INT) % 6 END AS articles, l.first_quantity FROM v_declarations d LEFT JOIN l ON l.id = d.id""")
def agg14(spark, d):
    lines = table(spark, d, "v_lines").groupBy(F.col("invoice_id").alias("id")).agg(F.count("*").alias("n"), F.min_by("quantite", F.struct("line_order", "montant_ligne")).alias("first_quantity"))
    declared = (parse_amount(F.col("nombre_colis")).cast("long") % 6).alias("declared")
    j = table(spark, d, "v_declarations").select("id", declared).join(lines, "id", "left")
    return j.select("id", F.when((F.col("n") > 1) & (F.col("n") > F.col("declared")), F.col("n")).otherwise(F.col("declared")).alias("articles"), "first_quantity")
