"""The library's tables, derived from the star schema. VIEWS holds one SELECT list each, valid in Spark SQL and as SQL elsewhere,
so the checks' SQL reads the same rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.functions.scalars import path_segment

NOW = "TIMESTAMP '2024-02-15 00:00:00'"

DAY = "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', CAST(year(o_orderdate) AS STRING))"

#: name: (source table, SELECT list)
VIEWS = {
    "v_users": ("customer", [
        "c_custkey AS id", "c_name AS username", "concat(lower(replace(c_name, '#', '')), '@example.com') AS email", "CASE WHEN c_custkey % 100 = 0 THEN 'admin' ELSE 'user' END AS role",
        "c_acctbal >= 0 AS is_active", "c_mktsegment <> 'MACHINERY' AS is_approved"]),
    "v_declarations": ("orders", [
        "o_orderkey AS id", "CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_custkey END AS user_id",
        "CASE WHEN o_orderkey % 23 = 0 THEN 'rejected' WHEN o_orderkey % 29 = 0 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'validated' WHEN o_orderstatus = 'O' THEN 'done' ELSE 'processing' END AS statut",
        "lpad(CAST(o_orderkey AS STRING), 6, '0') AS numero", "CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'EUR' WHEN o_orderkey % 3 = 1 THEN 'USD' ELSE 'TND' END AS devise",
        "CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN replace(CAST(CAST(o_totalprice AS DECIMAL(18,3)) AS STRING), '.', ',') ELSE CAST(CAST(o_totalprice AS DECIMAL(18,3)) AS STRING) END AS montant_ptfn",
        "CAST(o_orderkey % 40 + 1 AS STRING) AS nombre_colis", "CAST(o_orderkey % 900 + 20 AS STRING) AS poids_brut",
        "CAST(CASE WHEN o_orderkey % 37 = 0 THEN o_orderkey % 900 + 30 ELSE o_orderkey % 900 + 20 - o_orderkey % 15 END AS STRING) AS poids_net",
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'FOB' WHEN '2' THEN 'CIF' WHEN '3' THEN 'DAP' WHEN '4' THEN 'EXW' ELSE 'CFR' END AS mode_livraison",
        "o_orderdate + INTERVAL '23' YEAR AS created_at", f"CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {DAY} END AS date_declaration", "concat('dum_', CAST(o_orderkey AS STRING), '.pdf') AS fichier",
        "CAST(o_orderkey % 101 AS INT) AS score_confiance", "CAST(o_orderkey % 3 AS STRING) AS nbre_articles"]),
    "v_invoices": ("orders", [
        "o_orderkey AS id", "concat('FA', lpad(CAST(o_orderkey AS STRING), 7, '0')) AS numero", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS user_id",
        "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_totalprice + CASE o_orderkey % 5 WHEN 1 THEN 0.005 WHEN 2 THEN 0.5 WHEN 3 THEN -0.05 WHEN 4 THEN 25.0 ELSE 0.0 END END AS net_pay",
        "CASE WHEN o_orderkey % 82 = 0 THEN NULL ELSE o_totalprice END AS montant_ttc",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'USD' WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'EUR' WHEN o_orderkey % 3 = 1 THEN 'USD' ELSE 'TND' END AS devise",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS dum_id", "CASE WHEN o_orderkey % 4 = 0 THEN 'extracted' ELSE 'valide' END AS statut",
        "CAST(o_orderkey % 40 + 1 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS INT) AS nombre_colis",
        "CAST(o_orderkey % 900 + 20 - o_orderkey % 15 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS poids_net",
        "CASE WHEN o_orderkey % 21 = 0 THEN 'FCA' ELSE CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'FOB' WHEN '2' THEN 'CIF' WHEN '3' THEN 'DAP' WHEN '4' THEN 'EXW' ELSE 'CFR' END END AS mode_livraison",
        "o_orderdate + INTERVAL '23' YEAR + INTERVAL '1' DAY AS created_at", f"CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {DAY} END AS date_facture", "concat('fac_', CAST(o_orderkey AS STRING), '.pdf') AS fichier",
        "CASE WHEN o_orderkey % 9 <> 0 THEN lpad(CAST(o_orderkey AS STRING), 6, '0') END AS numero_declaration_dum", f"CASE WHEN o_orderkey % 9 <> 0 THEN {DAY} END AS date_declaration_dum", "CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS montant_declare_dum",
        "CASE WHEN o_orderkey % 18 > 9 THEN 'USD' END AS devise_declaree_dum", "CASE WHEN o_orderkey % 41 = 0 THEN CAST(0.004 AS DOUBLE) WHEN o_orderkey % 4 = 2 THEN CAST(0.5 AS DOUBLE) END AS ecart_montant", "CASE WHEN o_orderkey % 4 = 2 THEN 'à revoir' END AS ecart_commentaire",
        "CASE o_orderkey % 4 WHEN 1 THEN 'ok' WHEN 2 THEN 'warning' WHEN 3 THEN 'error' END AS statut_controle", "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL '23' YEAR + INTERVAL '2' DAY END AS compared_at", "CASE WHEN o_orderkey % 4 = 2 THEN '[]' END AS controle_anomalies_json"]),
    "v_lines": ("lineitem", ["l_orderkey AS invoice_id", "l_linenumber AS line_order", "l_quantity AS quantite", "l_extendedprice AS montant_ligne"]),
    "v_traces": ("lineitem", [
        "l_orderkey AS document_id", "l_shipdate AS uploaded_at", "l_partkey * 100000 + l_suppkey * 100 + l_linenumber AS id",
        "CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('user', CAST(l_suppkey AS STRING)) END AS username"]),
    "v_sessions": ("events", [
        "event_id AS id", "user_id * 10 + event_id % 10 AS document_id", "user_id AS validator_id", "CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'validated' WHEN 'signup' THEN 'rejected' ELSE 'other' END AS status",
        "ts AS started_at", "CASE WHEN event_type = 'view' THEN NULL ELSE ts + INTERVAL '1' HOUR END AS ended_at"]),
    "v_corrections": ("events", [
        "event_id AS id", "event_id AS session_id", "CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('field_', CAST(event_id % 8 AS STRING)) END AS field_key", "CAST(CAST(value AS DECIMAL(18,2)) AS STRING) AS new_value",
        "CASE event_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'delete' END AS action_type", "ts AS changed_at",
        "CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 300 + 1 END AS extracted_field_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'old' END AS old_value", "user_id AS changed_by"]),
    "v_fields": ("part", ["p_partkey AS id", "concat('field_', CAST(p_partkey % 8 AS STRING)) AS field_key", "p_name AS value"]),
    "v_articles": ("lineitem", ["l_orderkey AS document_id", "l_linenumber AS place", "l_linenumber % 3 + 1 AS num_ligne", "concat('620', CAST(l_suppkey % 2 AS STRING)) AS code_hs", "l_quantity AS quantite", "CAST(floor(l_extendedprice) AS BIGINT) % 2 AS total_ligne"]),
    "v_taxes": ("lineitem", ["l_orderkey AS document_id", "l_linenumber AS id", "concat('T', CAST(l_linenumber AS STRING)) AS code", "l_tax AS quotite"]),
    "v_logins": ("events", ["event_id AS id", "concat('10.0.0.', CAST(user_id % 20 AS STRING)) AS ip", "concat('user', CAST(user_id AS STRING), '@example.com') AS email", "event_type = 'error' AS failed", "ts AS at"]),
}
WITH = "WITH " + ", ".join(f"{name} AS (SELECT {', '.join(columns)} FROM {source})" for name, (source, columns) in VIEWS.items()) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one of VIEWS over it."""
    if name in VIEWS:
        source, columns = VIEWS[name]
        return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*columns)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archive_path(root: str, uploader: Column, at: Column, file: Column, invoice: Column) -> Column:
    """root[/factures]/uploader/yyyy/MM/dd/HHmmss_file, with segments of plain characters."""
    named = F.concat(F.date_format(at, "HHmmss"), F.lit("_"), path_segment(file, "document"))
    return F.concat_ws("/", F.lit(root), F.when(invoice, "factures"), path_segment(uploader, "inconnu"), F.date_format(at, "yyyy/MM/dd"), named)


def over(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """A query over the named tables, which go by names of this library in the session, so that the user's views stay."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"docrecon_{name}")
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 docrecon_{name}", sql)
    return spark.sql(sql)


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than there are cores is dealt over all of them, before costly work by row; others stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def id_ranges(counts: list[tuple[int, int]], low: int, width: int, parts: int) -> list[tuple[int, int]]:
    """Ranges [from, to) of about equal counts, `parts` of them or so: counts (bucket, rows) of buckets of `width` ids from low on."""
    total, out, start, held = sum(n for _, n in counts), [], low, 0
    for bucket, n in sorted(counts):
        held += n
        if held * parts >= total:
            out.append((start, low + (bucket + 1) * width))
            start, held = out[-1][1], 0
    if held:
        out.append((start, low + (max(b for b, _ in counts) + 1) * width))
    return out


def read_jdbc(spark: SparkSession, url: str, name: str, id: str = "id", parts: int = 8, after: int | None = None, buckets: int = 512, **options) -> tuple[DataFrame, int | None]:
    """A table of a relational database, and the largest id that it read: the next call's `after`, which reads only what came since.

    The database counts its rows in `buckets` ranges of ids of one width (a query whose result is as small), and the table is read in
    `parts` ranges of about as many rows each: gaps and bursts in the ids don't make one reader do all the work. Rows without id are
    read once, by a part of their own, where `after` isn't set. `id` is written as the database wants it, quoted if need be. Rows that come while it reads are left to the next call."""
    ask = lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    since = f" WHERE {id} > {int(after)}" if after is not None else ""
    low, high = ask(f"SELECT MIN({id}) AS lo, MAX({id}) AS hi FROM {name}{since}").first()
    if low is None:
        empty = [f"{id} IS NULL"] if after is None else ["1 = 0"]
        return spark.read.options(**options).jdbc(url, name, predicates=empty), after
    low, high = int(low), int(high)
    width = max(1, -(-(high - low + 1) // buckets))
    counted = ask(f"SELECT b, COUNT(*) AS n FROM (SELECT ({id} - {low}) / {width} AS b FROM {name} WHERE {id} BETWEEN {low} AND {high}) t GROUP BY b")
    counts = [(int(r.b), int(r.n)) for r in counted.toDF("b", "n").groupBy(F.floor("b").alias("b")).agg(F.sum("n").alias("n")).collect()]
    where = [f"{id} >= {a} AND {id} < {b} AND {id} <= {high}" for a, b in id_ranges(counts, low, width, parts)]
    return spark.read.options(**options).jdbc(url, name, predicates=where + ([f"{id} IS NULL"] if after is None else [])), high


def list_input_files(spark: SparkSession, folder: str, named: DataFrame | None = None) -> DataFrame:
    """Documents of a folder by the known extensions; with `named` (column file) only those in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.element_at(F.split("path", "/"), -1).alias("file"))
    files = files.where(F.lower("file").rlike(r"\.(png|jpe?g|tiff?|pdf)$"))
    return (files.join(named.select("file"), "file", "left_semi") if named is not None else files).orderBy("path")


def read_predictions(spark: SparkSession, path: str, part: str = "result") -> DataFrame:
    """A JSON array of {file, result or expected} as (file, field, value)."""
    rows = spark.read.json(path, multiLine=True)
    fields = [f.name for f in rows.schema[part].dataType.fields]
    return rows.select("file", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(part)[f].cast("string").alias("value")) for f in fields])).alias("x")).select("file", "x.field", "x.value")


def _csv_line(columns: list[Column]) -> Column:
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws(";", *cells)


BOM = "\ufeff"


def csv_text(lines: DataFrame, headings: list[str], order: list[str]) -> DataFrame:
    """(value): the lines of a CSV file as text, in order: a byte order mark and the plain headings, then quoted cells."""
    sorted_lines = lines.orderBy(*order).select(_csv_line([F.col(f"`{h}`") for h in headings]).alias("value"))
    head = lines.sparkSession.createDataFrame([(BOM + ";".join(headings),)], "value string")
    return head.union(sorted_lines)


def write_history_csv(lines: DataFrame, path: str, headings: list[str], order: list[str]) -> None:
    """History lines as CSV files; the first of them begins with the byte order mark and the headings, each next one goes on."""
    csv_text(lines, headings, order).write.mode("overwrite").text(path)


def report_lines(reports: DataFrame, rows: DataFrame, source: str, generated: Column) -> DataFrame:
    """(invoice_id, position, line): for each report (invoice_id, dum_id, numero_dum, numero_facture, pfn, net_pay, gap_abs, aligned,
    control, comment, compared_at) 14 lines about it, an empty line, the headings and its rows (invoice_id, place, category,
    dum_value, invoice_value, gap, tone)."""
    dash = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("—"))
    meta = [
        ("Généré le", F.date_format(generated, "dd/MM/yyyy HH:mm:ss")), ("Source", F.lit(source or "—")), ("ID DUM", dash("dum_id")), ("ID Facture", dash("invoice_id")), ("N° déclaration DUM", dash("numero_dum")), ("N° facture", dash("numero_facture")),
        ("PFN DUM", dash("pfn")), ("NET PAY facture", dash("net_pay")), ("Écart montant (abs.)", dash("gap_abs")), ("Montants alignés", F.when(F.col("aligned"), "Oui").otherwise("Non")), ("Statut contrôle", dash("control")), ("Commentaire", dash("comment")),
        ("Date comparaison", F.coalesce(F.date_format("compared_at", "dd/MM/yyyy HH:mm:ss"), F.lit("—")))]
    lines = [_csv_line([F.lit("Rapport de vérification croisée DUM — Facture")]), *[_csv_line([F.lit(name), value]) for name, value in meta], F.lit(""), _csv_line([F.lit(h) for h in ("Catégorie", "Valeur DUM", "Valeur facture", "Écart", "Statut ligne")])]
    head = reports.select("invoice_id", F.posexplode(F.array(*lines)).alias("position", "line"))
    body = rows.select("invoice_id", (F.lit(len(lines) - 1) + F.col("place")).cast("int").alias("position"), _csv_line([F.col(c) for c in ("category", "dum_value", "invoice_value", "gap", "tone")]).alias("line"))
    return head.unionByName(body)


def write_reports(lines: DataFrame, path: str) -> None:
    """Report lines as text, whole reports one after the other in files of about equal size; no folder for each report."""
    ordered = lines.repartitionByRange("invoice_id").sortWithinPartitions("invoice_id", "position")
    ordered.select(F.concat(F.when(F.col("position") == 0, BOM).otherwise(""), "line").alias("value")).write.mode("overwrite").text(path)
