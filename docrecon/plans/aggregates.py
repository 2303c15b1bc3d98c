"""Aggregations and reports."""

from pyspark.sql import functions as F

from docrecon.operators.core import field_f1, resolved_status
from docrecon.operators.history import history_stats
from docrecon.operators.reports import corrections_per_document, declaration_stats, document_stats, monthly_indicators, non_empty_coverage, row_counts, status_counts, totals_from_lines
from docrecon.plans.joins import HISTORY, history
from docrecon.registry import query
from docrecon.sources.tables import NOW, WITH, table

RESOLVED = """, ls AS (SELECT document_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(ended_at, started_at) DESC, id) AS n FROM v_sessions) WHERE n = 1),
resolved AS (SELECT d.*, CASE WHEN ls.status IN ('validated','rejected','in_progress') THEN ls.status ELSE coalesce(nullif(trim(d.statut), ''), 'pending') END AS resolved FROM v_declarations d LEFT JOIN ls ON ls.document_id = d.id)
"""


@query("agg1_document_stats", WITH + f"""SELECT d.user_id, count(*) AS documents_processed, count(*) FILTER (statut IN ('pending','processing','done')) AS pending_validation, count(*) FILTER (statut = 'validated') AS ready_for_erp, coalesce(max(v.n), 0) AS validated_this_month
FROM v_declarations d LEFT JOIN (SELECT e.user_id, count(*) AS n FROM v_sessions s JOIN v_declarations e ON e.id = s.document_id WHERE s.status = 'validated' AND s.ended_at >= date_trunc('month', {NOW}) GROUP BY 1) v ON v.user_id IS NOT DISTINCT FROM d.user_id GROUP BY d.user_id""")
def agg1(spark, d):
    return document_stats(table(spark, d, "v_declarations"), table(spark, d, "v_sessions"), F.expr(NOW), per_user=True)


@query("agg1_document_stats_all", WITH + f"""SELECT count(*) AS documents_processed, count(*) FILTER (statut IN ('pending','processing','done')) AS pending_validation, count(*) FILTER (statut = 'validated') AS ready_for_erp,
(SELECT count(*) FROM v_sessions s JOIN v_declarations e ON e.id = s.document_id WHERE s.status = 'validated' AND s.ended_at >= date_trunc('month', {NOW})) AS validated_this_month FROM v_declarations""")
def agg1_all(spark, d):
    return document_stats(table(spark, d, "v_declarations"), table(spark, d, "v_sessions"), F.expr(NOW))


@query("agg2_monthly_indicators", WITH + f""", m AS (SELECT unnest(generate_series(date_trunc('month', {NOW}) - INTERVAL 5 MONTH, date_trunc('month', {NOW}), INTERVAL 1 MONTH)) AS month)
SELECT CAST(m.month AS TIMESTAMP) AS month, ['Jan','Fév','Mar','Avr','Mai','Juin','Juil','Août','Sep','Oct','Nov','Déc'][CAST(month(m.month) AS INT)] || ' ' || CAST(year(m.month) AS STRING) AS label, coalesce(c.n, 0) AS created, coalesce(s.n, 0) AS validated FROM m
LEFT JOIN (SELECT date_trunc('month', created_at) AS month, count(*) AS n FROM v_declarations GROUP BY 1) c ON c.month = m.month
LEFT JOIN (SELECT date_trunc('month', ended_at) AS month, count(*) AS n FROM v_sessions WHERE status = 'validated' GROUP BY 1) s ON s.month = m.month""")
def agg2(spark, d):
    return monthly_indicators(table(spark, d, "v_declarations"), table(spark, d, "v_sessions"), F.expr(NOW))


@query("agg3_user_stats", WITH + "SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (is_approved) AS approved, count(*) FILTER (role = 'admin') AS admins FROM v_users")
def agg3(spark, d):
    return table(spark, d, "v_users").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if("is_approved").alias("approved"), F.count_if(F.col("role") == "admin").alias("admins"))


@query("agg4_history_status_counts", WITH + RESOLVED + "SELECT resolved AS status, count(*) AS n FROM resolved GROUP BY 1")
def agg4(spark, d):
    return status_counts(resolved_status(table(spark, d, "v_declarations"), table(spark, d, "v_sessions")))


@query("agg5_history_stats", WITH + RESOLVED + "SELECT count(*) AS total, count(*) FILTER (resolved = 'validated') AS validated, count(*) FILTER (resolved IN ('in_progress','pending','processing')) AS in_progress, count(DISTINCT user_id) AS owners FROM resolved")
def agg5(spark, d):
    return declaration_stats(resolved_status(table(spark, d, "v_declarations"), table(spark, d, "v_sessions")))


@query("agg5_unified_history_stats", HISTORY + "SELECT count(*) AS total, count(*) FILTER (filter_key = 'validated') AS validated, count(*) FILTER (filter_key IN ('in_progress', 'pending')) AS in_progress, count(*) FILTER (control = 'ok') AS reconciled_ok, count(*) FILTER (reconciled AND control IN ('warning', 'error')) AS reconciled_warning, count(DISTINCT owner) AS owners FROM items")
def agg5_unified(spark, d):
    return history_stats(history(spark, d))


FIELDS = ["numero", "devise", "montant_ptfn", "nombre_colis", "poids_net", "mode_livraison"]
STEPS = [("0.58", 11), ("0.62", 17), ("0.68", 13)]
TRUTH_SQL = ", gt AS (" + " UNION ALL ".join(f"SELECT id AS file, '{f}' AS field, {f} AS value FROM v_declarations" for f in FIELDS) + "), pr AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS threshold, file, field, CASE WHEN file % {m} = length(field) % {m} THEN NULL WHEN file % {m} = 1 THEN 'x' ELSE value END AS value FROM gt" for t, m in STEPS) + """), f1 AS (
SELECT threshold, field, tp, fp, fn, documents, round((tp + fp) / documents, 4) AS coverage, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1
FROM (SELECT threshold, field, count(*) FILTER (t <> '' AND t = p) AS tp, count(*) FILTER (t <> p AND p <> '') AS fp, count(*) FILTER (t <> '' AND t <> p) AS fn, count(*) AS documents
FROM (SELECT threshold, field, lower(trim(coalesce(gt.value, ''))) AS t, lower(trim(coalesce(pr.value, ''))) AS p FROM gt JOIN pr USING (file, field)) GROUP BY 1, 2)) """


def truth(spark, d):
    return table(spark, d, "v_declarations").select("id", *FIELDS).unpivot("id", FIELDS, "field", "value").withColumnRenamed("id", "file")


def predictions(spark, d):
    t, out = truth(spark, d), None
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("threshold"), F.lit(m).alias("m")) for s, m in STEPS]))
    p = t.select("*", steps.alias("s")).select("file", "field", "value", "s.threshold", "s.m")
    rest = F.col("file") % F.col("m")
    return p.withColumn("value", F.when(rest == F.length("field") % F.col("m"), None).when(rest == 1, "x").otherwise(F.col("value"))).drop("m")


@query("agg7_field_f1", WITH + TRUTH_SQL + "SELECT * FROM f1")
def agg7(spark, d):
    return field_f1(truth(spark, d), predictions(spark, d), ["threshold"], [(s,) for s, _ in STEPS])


CRITICAL = ["numero", "devise", "montant_ptfn"]


def summary(spark, d):
    f = field_f1(truth(spark, d), predictions(spark, d), ["threshold"], [(s,) for s, _ in STEPS])
    f1 = F.col("f1").cast("decimal(10,4)")
    mean = lambda c, name: F.round(F.avg(c), 4).cast("double").alias(name)
    return f.groupBy("threshold").agg(mean(f1, "macro_f1"), mean(F.when(F.col("field").isin(CRITICAL), f1), "critical_f1"), F.max("documents").alias("documents"))


CRITICAL_SQL = "CAST(round(CAST(avg(f1) FILTER (field IN ('numero','devise','montant_ptfn')) AS DECIMAL(18,8)), 4) AS DOUBLE)"
MACRO_SQL = f"SELECT threshold, CAST(round(CAST(avg(f1) AS DECIMAL(18,8)), 4) AS DOUBLE) AS macro_f1, {CRITICAL_SQL} AS critical_f1, max(documents) AS documents"


@query("agg8_macro_critical_f1", WITH + TRUTH_SQL + MACRO_SQL + f", {CRITICAL_SQL} >= 0.8 AS passed FROM f1 GROUP BY 1")
def agg8(spark, d):
    return summary(spark, d).withColumn("passed", F.col("critical_f1") >= 0.8)


@query("agg9_threshold_calibration", WITH + TRUTH_SQL + f"SELECT arg_max(threshold, critical_f1 * 1000 + macro_f1) AS best, round(stddev_pop(critical_f1), 6) AS spread FROM ({MACRO_SQL} FROM f1 GROUP BY 1)")
def agg9(spark, d):
    return summary(spark, d).agg(F.max_by("threshold", F.struct("critical_f1", "macro_f1")).alias("best"), F.round(F.stddev_pop("critical_f1"), 6).alias("spread"))


@query("agg10_non_empty_coverage", WITH + TRUTH_SQL + """, p AS (SELECT *, CASE WHEN file % 50 = 7 THEN 'timeout' END AS error FROM pr) SELECT threshold, field, round(avg(CASE WHEN error IS NULL AND coalesce(trim(value), '') <> '' THEN 1.0 ELSE 0.0 END), 3) AS coverage, count(*) AS documents, count(error) AS in_error FROM p GROUP BY 1, 2""")
def agg10(spark, d):
    rows = predictions(spark, d).withColumn("error", F.when(F.col("file") % 50 == 7, "timeout"))
    return non_empty_coverage(rows, ["threshold", "field"])


@query("agg13_line_total_fallback", WITH + """SELECT i.id, use, CASE WHEN use THEN l.total ELSE i.net_pay END AS net_pay, CASE WHEN use THEN l.total ELSE i.montant_ttc END AS montant_ttc, CASE WHEN use THEN l.total ELSE i.net_pay END AS montant_brut, CASE WHEN use THEN l.total END AS montant_net, CASE WHEN use THEN greatest(0.72, (i.id % 100) / 100.0) ELSE (i.id % 100) / 100.0 END AS confidence
FROM v_invoices i LEFT JOIN (SELECT invoice_id, CAST(sum(CAST(montant_ligne AS DECIMAL(18,2))) FILTER (montant_ligne > 0) AS DOUBLE) AS total FROM v_lines GROUP BY 1) l ON l.invoice_id = i.id, LATERAL (SELECT coalesce(i.net_pay, 0) < 30000 AND coalesce(l.total, 0) >= 500 AS use) u""")
def agg13(spark, d):
    invoices = table(spark, d, "v_invoices").withColumns({"montant_brut": F.col("net_pay"), "montant_net": F.lit(None).cast("double"), "confidence": F.col("id") % 100 / 100})
    out = totals_from_lines(invoices, table(spark, d, "v_lines"), least=30000.0)
    return out.select("id", F.col("totals_from_lines").alias("use"), "net_pay", "montant_ttc", "montant_brut", "montant_net", "confidence")


@query("agg16_page_word_stats", "SELECT source, count(*) AS pages, sum(len(regexp_extract_all(text, '[A-Za-z0-9_]+')))::BIGINT AS words, sum(length(text))::BIGINT AS chars, round(avg(len(regexp_extract_all(text, '[A-Za-z0-9_]+'))), 1) AS mean_words FROM documents GROUP BY source")
def agg16(spark, d):
    n = F.regexp_count("text", F.lit("[A-Za-z0-9_]+"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("pages"), F.sum(n).alias("words"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(n), 1).alias("mean_words"))


@query("agg18_corrections_per_document", WITH + """SELECT s.document_id, count(*) AS corrections, concat(CAST(count(*) AS STRING), ' correction', CASE WHEN count(*) > 1 THEN 's' ELSE '' END, coalesce(' · ' || arg_max(u.username, struct_pack(a := c.changed_at, i := c.id)), '')) AS hint
FROM v_corrections c JOIN v_sessions s ON s.id = c.session_id LEFT JOIN v_users u ON u.id = s.validator_id GROUP BY 1""")
def agg18(spark, d):
    return corrections_per_document(table(spark, d, "v_corrections"), table(spark, d, "v_sessions"), table(spark, d, "v_users"))


@query("agg17_row_counts", WITH + " UNION ALL ".join(f"SELECT '{t}' AS source, 'rows' AS what, count(*) AS value FROM {t} UNION ALL (SELECT '{t}', 'id', id FROM {t} ORDER BY id DESC LIMIT 10)" for t in ("v_invoices", "v_declarations", "v_users")))
def agg17(spark, d):
    return row_counts({t: table(spark, d, t) for t in ("v_invoices", "v_declarations", "v_users")})
