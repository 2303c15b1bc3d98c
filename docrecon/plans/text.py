"""Scalar rules and extraction over text columns."""

import unicodedata

from pyspark.sql import functions as F

from docrecon.functions.scalars import amount_eu, fold_text, name_similarity, parse_amount, parse_int_amount, with_folded
from docrecon.operators.extraction import near_anchor
from docrecon.operators.field_rules import text_profile
from docrecon.registry import query
from docrecon.sources.tables import WITH, table


@query("scl1_parse_amount", WITH + "SELECT id, CAST(replace(montant_ptfn, ',', '.') AS DOUBLE) AS amount, CAST(round_even(CAST(replace(montant_ptfn, ',', '.') AS DOUBLE), 0) AS INT) AS whole, CAST(replace(montant_ptfn, ',', '.') AS DOUBLE) AS eu FROM v_declarations")
def scl1(spark, d):
    c = F.col("montant_ptfn")
    return table(spark, d, "v_declarations").select("id", parse_amount(c).alias("amount"), parse_int_amount(c).alias("whole"), amount_eu(c).alias("eu"))


@query("scl8_fold_text", "SELECT doc_id, upper(strip_accents(replace(text, 'ß', 'ss'))) AS folded FROM documents")
def scl8(spark, d):
    return table(spark, d, "documents").select("doc_id", fold_text(F.col("text")).alias("folded"))


SCRIPTS = "CASE doc_id % 4 WHEN 0 THEN '한글 ｶﾞ' WHEN 1 THEN 'ﷺ ㎏' WHEN 2 THEN 'Ωμέγα Ёлка' ELSE 'é' END"


@query("scl8_fold_whole", f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN nfkd_a WHEN 1 THEN nfkd_b WHEN 2 THEN 'ΩΜΕΓΑ ЕЛКА' ELSE 'E' END AS folded FROM (SELECT doc_id, '{unicodedata.normalize('NFKD', '한글 カ')}' AS nfkd_a, '{unicodedata.normalize('NFKD', 'ﷺ')} KG' AS nfkd_b FROM documents)")
def scl8_whole(spark, d):
    return with_folded(table(spark, d, "documents").select("doc_id", F.expr(SCRIPTS).alias("text")), "text").drop("text")


@query("scl14_name_similarity", "SELECT p_partkey, CASE WHEN length(p_type) >= 4 AND list_contains(list_filter(string_split(upper(p_name), ' '), lambda t: length(t) >= 4), p_type) THEN 1.0 / len(list_distinct(list_filter(string_split(upper(p_name), ' '), lambda t: length(t) >= 4))) ELSE 0.0 END AS similarity FROM part")
def scl14(spark, d):
    return table(spark, d, "part").select("p_partkey", name_similarity(F.col("p_name"), F.col("p_type")).alias("similarity"))


@query("ext11_anchor_numeric", "SELECT doc_id, nullif(regexp_extract(regexp_extract(upper(text), 'VERSION([\\s\\S]{0,120})', 1), '\\b([0-9]{1,3})\\b', 1), '') AS version FROM documents")
def ext11(spark, d):
    return table(spark, d, "documents").select("doc_id", near_anchor(F.upper("text"), "VERSION", 1, 3).alias("version"))


PROFILED = "CASE doc_id % 6 WHEN 0 THEN 'Déclaration en détail' WHEN 1 THEN 'certificat de décharge SA 12345' WHEN 2 THEN 'douanes tunisiennes / sa1234567' WHEN 3 THEN 'Douanes Tunisiennes' WHEN 4 THEN 'Déclaration en detail' ELSE '' END"


@query("scl19_text_profile", f"""SELECT doc_id, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 400 AS enough, ['dum_detail', 'sa_text', 'sa_text', 'tunisia_customs', 'unknown', 'unknown'][doc_id % 6 + 1] AS profile, CASE WHEN doc_id % 6 IN (2, 3) THEN 1 ELSE 0 END AS customs
FROM (SELECT doc_id, concat({PROFILED}, chr(10), text) AS t FROM documents)""")
def scl19(spark, d):
    out = table(spark, d, "documents").select("doc_id", text_profile(F.concat(F.expr(PROFILED), F.lit("\n"), "text")).alias("p"))
    return out.select("doc_id", "p.letters", "p.enough", "p.profile", F.coalesce(F.try_element_at("p.hits", F.lit("tunisia_customs")), F.lit(0)).alias("customs"))
