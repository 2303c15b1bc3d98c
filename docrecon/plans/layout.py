"""Zones, cells, pages, recognition attempts and batches; values found in the text of documents."""

from pyspark.sql import functions as F

from docrecon.operators.core import latest
from docrecon.operators.layout import CHAPTER, SECTION, batch_outcome, best_candidates, group_cells, merge_pages, outline, zone_overlaps
from docrecon.registry import query
from docrecon.sources.tables import over, table

ID = "l_partkey * 100000 + l_suppkey * 100 + l_linenumber AS id"
ZONES = f"SELECT l_orderkey AS page, {ID}, l_partkey % 40 AS x1, l_suppkey % 40 AS y1, l_partkey % 40 + CAST(l_quantity AS BIGINT) AS x2, l_suppkey % 40 + l_linenumber * 3 AS y2 FROM lineitem"
CELLS = f"SELECT l_orderkey AS page, {ID}, l_suppkey % 500 AS x, l_partkey % 60 AS y FROM lineitem"
ATTEMPTS = f"SELECT l_orderkey AS zone, {ID}, l_returnflag = 'A' AS valid, (round(l_tax * 100) * 20 - 20) / CAST(100 AS DOUBLE) AS confidence FROM lineitem"
PAGES = f"SELECT l_orderkey AS doc, l_linenumber AS page, {ID}, CASE l_returnflag WHEN 'N' THEN ' ' WHEN 'R' THEN NULL ELSE CAST(l_partkey AS STRING) END AS first_field, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_suppkey AS STRING) END AS last_field, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS quality, CAST(l_suppkey AS STRING) AS text FROM lineitem"
# Rows of duties (code, base, rate, amount) and amounts with their currency.
DUTY = r"\b(\d{3})\s+(\d{1,10}[,.]\d{3})\s+(\d{1,6}[,.]\d{6})\s+(\d{1,10}[,.]\d{3})"
MONEY = r"\b(USD|EUR|GBP|TND|CHF|JPY|CAD)\s+(\d{3,12}[,.]\d{3})\b"
DUTIES = "SELECT l_orderkey AS id, l_linenumber AS line, concat('duty ', lpad(CAST(l_partkey % 1000 AS STRING), 3, '0'), ' ', CAST(CAST(l_extendedprice AS DECIMAL(12,3)) AS STRING), ' ', CAST(CAST(l_tax AS DECIMAL(8,6)) AS STRING), ' ', CAST(CAST(l_quantity AS DECIMAL(12,3)) AS STRING), ' end') AS text FROM lineitem"
TOTALS = "SELECT o_orderkey AS id, concat('total ', CASE o_orderkey % 3 WHEN 0 THEN 'eur' WHEN 1 THEN 'USD' ELSE 'XYZ' END, ' ', replace(CAST(CAST(o_totalprice AS DECIMAL(14,3)) AS STRING), '.', ','), ' end') AS text FROM orders"


def rows(spark, d, sql):
    return over(spark, d, sql, "lineitem", "orders")


@query("jn11_zone_overlap", f"WITH z AS ({ZONES}) SELECT a.page, a.id AS a, b.id AS b FROM z a JOIN z b ON a.page = b.page AND a.id < b.id AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1")
def jn11(spark, d):
    return zone_overlaps(rows(spark, d, ZONES))


@query("win9_cell_row_grouping", f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, id) AS n FROM ({CELLS})),
r AS (SELECT page, n, id, x, y AS anchor, 1 AS row FROM c WHERE n = 1 UNION ALL SELECT c.page, c.n, c.id, c.x, CASE WHEN abs(c.y - r.anchor) > 14 THEN c.y ELSE r.anchor END, r.row + CASE WHEN abs(c.y - r.anchor) > 14 THEN 1 ELSE 0 END FROM r JOIN c ON c.page = r.page AND c.n = r.n + 1)
SELECT page, row, string_agg(CAST(id AS STRING), ' ' ORDER BY x, id) AS cells FROM r GROUP BY page, row""")
def win9(spark, d):
    placed = group_cells(rows(spark, d, CELLS)).groupBy("page", "row").agg(F.sort_array(F.collect_list(F.struct("x", "id"))).alias("c"))
    return placed.select("page", "row", F.array_join(F.transform("c", lambda c: c["id"].cast("string")), " ").alias("cells"))


@query("win6_best_engine_candidate", f"""WITH a AS (SELECT *, round(CASE WHEN valid THEN 1.45 ELSE 0.0 END + greatest(0.0, least(1.0, confidence)), 4) AS score, valid AND confidence >= 0.9 AS stop FROM ({ATTEMPTS}))
SELECT zone, id, score FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY stop DESC, CASE WHEN NOT stop THEN score END DESC NULLS LAST, id) AS n FROM a) WHERE n = 1""")
def win6(spark, d):
    return best_candidates(rows(spark, d, ATTEMPTS), ["zone"], [F.col("id")]).select("zone", "id", "score")


TAGS = f"SELECT l_orderkey AS page, l_linenumber % 3 AS field, {ID}, CASE l_returnflag WHEN 'A' THEN 'header_cell' WHEN 'N' THEN 'fixed_zone' ELSE 'other' END AS tag FROM lineitem"


@query("win4_zone_record_priority", f"SELECT page, field, id, tag FROM (SELECT *, row_number() OVER (PARTITION BY page, field ORDER BY CASE tag WHEN 'header_cell' THEN 0 WHEN 'fixed_zone' THEN 1 ELSE 2 END, id) AS n FROM ({TAGS})) WHERE n = 1")
def win4(spark, d):
    priority = F.when(F.col("tag") == "header_cell", 0).when(F.col("tag") == "fixed_zone", 1).otherwise(2)
    return latest(rows(spark, d, TAGS), ["page", "field"], [priority, F.col("id")]).select("page", "field", "id", "tag")


@query("agg11_registration_quality", """WITH m AS (SELECT o_orderkey AS id, coalesce(round(sum(CAST(round(l_discount * 100) AS INT)) / (10.0 * count(l_discount)), 4), 0.0) AS mean FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT id, mean, CASE WHEN mean >= 0.8 THEN 'HIGH' WHEN mean >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM m""")
def agg11(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.round(F.col("l_discount") * 100).cast("int")).alias("s"), F.count("l_discount").alias("n"))
    mean = F.coalesce(F.round(F.col("s") / (F.lit(10.0) * F.col("n")), 4), F.lit(0.0))
    out = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(pages, "id", "left").select("id", mean.alias("mean"))
    return out.withColumn("level", F.when(F.col("mean") >= 0.8, "HIGH").when(F.col("mean") >= 0.55, "MEDIUM").otherwise("LOW"))


@query("agg12_page_merge", f"""WITH p AS ({PAGES}) SELECT doc, arg_min(first_field, struct_pack(p := page, i := id)) FILTER (trim(first_field) <> '') AS first_field, arg_max(last_field, struct_pack(p := page, i := id)) FILTER (trim(last_field) <> '') AS last_field,
string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags, CAST(sum(quality) AS BIGINT) AS quality_sum, sum(quality) / count(quality) AS quality_mean, string_agg(text, '|' ORDER BY page, id) AS text FROM p GROUP BY doc""")
def agg12(spark, d):
    return merge_pages(rows(spark, d, PAGES), ["page", "id"])


@query("agg19_batch_outcome", "SELECT strftime(ts, '%Y-%m-%d') AS batch, count(*) AS n, count(*) FILTER (event_type <> 'error') AS done, count(*) FILTER (event_type = 'error') AS failed, arg_min(concat('timeout ', CAST(user_id AS STRING)), event_id) FILTER (event_type = 'error') AS first_error FROM events GROUP BY 1")
def agg19(spark, d):
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("timeout "), F.col("user_id").cast("string")))
    return batch_outcome(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("batch"), F.col("event_id").alias("id"), error.alias("error")))


@query("ext8_tax_rows", f"WITH t AS ({DUTIES}) SELECT id, line, " + ", ".join(f"regexp_extract(text, '{DUTY}', {i}) AS {c}" for i, c in enumerate(["code", "base", "rate", "amount"], 1)) + f" FROM t WHERE regexp_matches(text, '{DUTY}')")
def ext8(spark, d):
    groups = [F.regexp_extract_all("text", F.lit(DUTY), F.lit(i)).alias(c) for i, c in enumerate(["code", "base", "rate", "amount"], 1)]
    found = rows(spark, d, DUTIES).select("id", "line", F.explode(F.arrays_zip(*groups)).alias("x"))
    return found.select("id", "line", "x.code", "x.base", "x.rate", "x.amount")


@query("ext3_financials", f"WITH t AS ({TOTALS}) SELECT id, upper(regexp_extract(text, '(?i){MONEY}', 1)) AS currency, CAST(nullif(replace(regexp_extract(text, '(?i){MONEY}', 2), ',', '.'), '') AS DOUBLE) AS amount FROM t")
def ext3(spark, d):
    part = lambda i: F.regexp_extract("text", "(?i)" + MONEY, i)
    return rows(spark, d, TOTALS).select("id", F.upper(part(1)).alias("currency"), F.replace(part(2), F.lit(","), F.lit(".")).try_cast("double").alias("amount"))


HEADED = "concat('  Chapitre ', CASE doc_id % 3 WHEN 0 THEN 'IV' WHEN 1 THEN '12' ELSE 'de la' END, ' : la  mise', chr(10), chr(10), CASE WHEN doc_id % 2 = 0 THEN '1.2.' ELSE '3 ' END, CAST(doc_id % 9 AS STRING), ' Objet du texte', chr(10), '4.1 Figure de page', chr(10), CASE WHEN doc_id % 5 = 0 THEN '7 no' ELSE '7.1 Suite' END, chr(10), text)"


@query("ext16_document_outline", f"""WITH d AS (SELECT doc_id, {HEADED} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d), f AS (SELECT doc_id, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM l WHERE trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) <> '')
SELECT doc_id, n, CASE WHEN regexp_matches(line, '(?i){CHAPTER}') THEN 'chapter' ELSE 'section' END AS kind, line FROM f WHERE n <= 8 AND (regexp_matches(line, '(?i){CHAPTER}') OR regexp_matches(line, '{SECTION}') AND NOT regexp_matches(regexp_extract(line, '{SECTION}', 2), '(?i)^(figure|tableau)'))""")
def ext16(spark, d):
    return outline(table(spark, d, "documents").select("doc_id", F.expr(HEADED).alias("text")))
