"""Filters, visibility, latest rows, sorts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docrecon.functions.scalars import dum_validated, invoice_validated
from docrecon.operators.core import INVOICE_TEXT, RAW_TEXT, clamp, latest_sessions, newest, visible
from docrecon.operators.history import deep_page, heavy_pages, line_contexts, long_contexts, page, recent_activity
from docrecon.plans.joins import HISTORY, owned
from docrecon.registry import query
from docrecon.sources.tables import WITH, archive_path, table


@query("flt1_visible_documents", WITH + "SELECT id, user_id, statut FROM v_declarations WHERE user_id = 7")
def flt1(spark, d):
    return visible(table(spark, d, "v_declarations"), 7).select("id", "user_id", "statut")


@query("flt2_visible_invoices", WITH + "SELECT id, user_id, statut FROM v_invoices WHERE user_id = 7 OR user_id IS NULL")
def flt2(spark, d):
    return visible(table(spark, d, "v_invoices"), 7, ownerless=True).select("id", "user_id", "statut")


@query("flt3_document_access", WITH + """, t AS (SELECT document_id, username, row_number() OVER (PARTITION BY document_id ORDER BY uploaded_at DESC, id DESC) AS n FROM v_traces)
SELECT d.id, coalesce(CAST(d.user_id AS STRING), nullif(t.username, ''), 'open') AS owner FROM v_declarations d LEFT JOIN (SELECT * FROM t WHERE n = 1) t ON t.document_id = d.id""")
def flt3(spark, d):
    last = newest(table(spark, d, "v_traces").select("document_id", "id", "username", "uploaded_at"), ["document_id"], [F.col("uploaded_at"), F.col("id")]).select(F.col("document_id").alias("id"), "username")
    return table(spark, d, "v_declarations").join(last, "id", "left").select("id", F.coalesce(F.col("user_id").cast("string"), F.nullif("username", F.lit("")), F.lit("open")).alias("owner"))


@query("flt4_invoice_access", WITH + "SELECT id FROM v_invoices WHERE user_id = 7")
def flt4(spark, d):
    return visible(table(spark, d, "v_invoices"), 7).select("id")


@query("flt6_pending_users", WITH + "SELECT id, username, email FROM v_users WHERE NOT is_approved")
def flt6(spark, d):
    return table(spark, d, "v_users").where("not is_approved").select("id", "username", "email").orderBy("id")


@query("flt8_validated_predicates", WITH + "SELECT i.id, lower(trim(d.statut)) IN ('validated','valide') AS dum_ok, lower(trim(i.statut)) IN ('valide','controle_croise','controle_ok','controle_warning','controle_ecart') AS invoice_ok FROM v_invoices i JOIN v_declarations d ON d.id = i.dum_id")
def flt8(spark, d):
    dums = table(spark, d, "v_declarations").select(F.col("id").alias("dum_id"), dum_validated(F.col("statut")).alias("dum_ok"))
    return table(spark, d, "v_invoices").join(dums, "dum_id").select("id", "dum_ok", invoice_validated(F.col("statut")).alias("invoice_ok"))


@query("flt9_clamp_strings", "SELECT doc_id, substring(text, 1, 5000) AS raw_text, substring(source, 1, 4) AS source, lang, n_chars FROM documents")
def flt9(spark, d):
    return clamp(table(spark, d, "documents").withColumnRenamed("text", "raw_text"), {"raw_text": RAW_TEXT, "source": 4, "not_there": 9})


@query("flt9_clamp_invoice_text", "SELECT doc_id, substring(text, 1, 120000) AS text, length(substring(text, 1, 120000)) AS n FROM documents")
def flt9_invoices(spark, d):
    return clamp(table(spark, d, "documents").select("doc_id", "text"), {"text": INVOICE_TEXT}).withColumn("n", F.length("text").cast("long"))


@query("win1_latest_session", WITH + "SELECT id, document_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(ended_at, started_at) DESC, id) AS n FROM v_sessions) WHERE n = 1")
def win1(spark, d):
    return latest_sessions(table(spark, d, "v_sessions")).select("id", "document_id", "status")


@query("win2_latest_corrections", WITH + """SELECT document_id, field_key, new_value, id FROM (SELECT s.document_id, c.field_key, c.new_value, c.id, row_number() OVER (PARTITION BY s.document_id, c.field_key ORDER BY c.changed_at DESC, c.id DESC) AS n
FROM v_corrections c JOIN v_sessions s ON s.id = c.session_id WHERE c.field_key IS NOT NULL) WHERE n = 1""")
def win2(spark, d):
    s = table(spark, d, "v_sessions").select(F.col("id").alias("session_id"), "document_id")
    c = table(spark, d, "v_corrections").where("field_key is not null").join(s, "session_id")
    return newest(c.select("document_id", "field_key", "new_value", "id", "changed_at"), ["document_id", "field_key"], [F.col("changed_at"), F.col("id")]).select("document_id", "field_key", "new_value", "id")


@query("win3_latest_upload_trace", WITH + "SELECT document_id, id, username FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY uploaded_at DESC, id DESC) AS n FROM v_traces) WHERE n = 1")
def win3(spark, d):
    return newest(table(spark, d, "v_traces").select("document_id", "id", "username", "uploaded_at"), ["document_id"], [F.col("uploaded_at"), F.col("id")]).select("document_id", "id", "username")


@query("win10_failed_login_15m", WITH + "SELECT id, count(*) OVER (PARTITION BY lower(trim(email)), ip ORDER BY v_logins.at RANGE BETWEEN INTERVAL '900' SECOND PRECEDING AND CURRENT ROW) AS n FROM v_logins WHERE failed")
def win10(spark, d):
    w = Window.partitionBy(F.lower(F.trim("email")), "ip").orderBy(F.unix_micros(F.col("at").cast("timestamp"))).rangeBetween(-900_000_000, 0)
    return table(spark, d, "v_logins").where("failed").select("id", F.count("*").over(w).alias("n"))


@query("win11_history_paging", WITH + "SELECT id, created_at, (SELECT count(*) FROM v_declarations) AS total FROM v_declarations ORDER BY created_at DESC, id DESC LIMIT 200 OFFSET 100")
def win11(spark, d):
    rows, total = deep_page(table(spark, d, "v_declarations").select("id", "created_at"), skip=100, limit=500)
    return rows.withColumn("total", F.lit(total).cast("long"))


@query("srt1_recent_activity", HISTORY + "SELECT document_id, document, date, status, tone, owner FROM hist ORDER BY created_at DESC, document_id DESC LIMIT 20")
def srt1(spark, d):
    return recent_activity(table(spark, d, "v_declarations"), table(spark, d, "v_sessions"), table(spark, d, "v_users"), 50)


@query("srt3_invoice_summaries", HISTORY + "SELECT id, numero, owner FROM owned ORDER BY created_at DESC, id DESC LIMIT 100")
def srt3(spark, d):
    top, _ = page(table(spark, d, "v_invoices"), [F.desc("created_at"), F.desc("id")], 0, 100)
    return owned(spark, d, top).select("id", "numero", "owner")


WORDS = r"[\p{L}\p{N}_]+"
KINDS = {"diagram": r"(?i)\bcopyright\b", "figure": r"(?i)licen[cs]e"}
CONTEXTS = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), f AS (SELECT doc_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line, pos FROM l), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM f WHERE line <> ''),
c AS (SELECT doc_id, n, line, coalesce(string_agg(line, ' ') OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '') AS before FROM g),
ctx AS (SELECT doc_id, n, substring(line, 1, 220) AS line, CASE WHEN regexp_matches(line, '(?i)\\bcopyright\\b') THEN 'diagram' ELSE 'figure' END AS kind, len(regexp_extract_all(before, '{WORDS}')) AS before_words, right(before, 450) AS before_excerpt FROM c WHERE regexp_matches(line, '(?i)\\bcopyright\\b|licen[cs]e')) """


@query("win8_line_context", CONTEXTS + "SELECT * FROM ctx")
def win8(spark, d):
    return line_contexts(table(spark, d, "documents"), KINDS)


@query("srt5_heavy_pages", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORDS}')) AS BIGINT) AS words FROM documents ORDER BY words DESC, doc_id LIMIT 20")
def srt5(spark, d):
    return heavy_pages(table(spark, d, "documents"))


@query("srt5_long_contexts", CONTEXTS + "SELECT * FROM ctx WHERE before_words >= 45 ORDER BY before_words DESC, doc_id, n LIMIT 80")
def srt5_contexts(spark, d):
    return long_contexts(line_contexts(table(spark, d, "documents"), KINDS))


@query("src8_archive_layout", WITH + """SELECT t.id, t.document_id, concat_ws('/', 'archive', CASE WHEN id % 2 = 0 THEN 'factures' END, coalesce(nullif(regexp_replace(regexp_replace(username, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'inconnu'), strftime(uploaded_at, '%Y/%m/%d'), concat(strftime(uploaded_at, '%H%M%S'), '_', 'a_', CAST(id AS STRING), '.pdf')) AS path FROM v_traces t""")
def src8(spark, d):
    name = F.concat(F.lit("..a / "), F.col("id").cast("string"), F.lit(".pdf"))
    return table(spark, d, "v_traces").select("id", "document_id", archive_path("archive", F.col("username"), F.col("uploaded_at"), name, F.col("id") % 2 == 0).alias("path"))
