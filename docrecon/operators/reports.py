"""Counts and reports over documents, sessions, corrections and predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_stats(declarations: DataFrame, sessions: DataFrame, now: Column, per_user: bool = False) -> DataFrame:
    """Documents, those to be validated, those ready for the ERP, and sessions validated since the month began; over all or by
    user_id."""
    s = F.col("statut")
    counts = [F.count("*").alias("documents_processed"), F.count_if(s.isin("pending", "processing", "done")).alias("pending_validation"), F.count_if(s == "validated").alias("ready_for_erp")]
    recent = sessions.where((F.col("status") == "validated") & (F.col("ended_at") >= F.date_trunc("month", now)))
    done = recent.select(F.col("document_id").alias("id")).join(declarations.select("id", "user_id"), "id")
    if not per_user:
        # Both sides are added up in one pass; a session counts as no document.
        rows = declarations.select(F.lit(False).alias("done"), "statut").unionByName(done.select(F.lit(True).alias("done"), F.lit(None).cast("string").alias("statut")))
        return rows.agg(F.count_if(~F.col("done")).alias("documents_processed"), *counts[1:], F.count_if("done").alias("validated_this_month"))
    done = done.groupBy(F.col("user_id").alias("of")).agg(F.count("*").alias("n"))
    j = declarations.groupBy("user_id").agg(*counts).join(done, F.col("user_id").eqNullSafe(F.col("of")), "left")
    return j.drop("of").withColumn("validated_this_month", F.coalesce("n", F.lit(0))).drop("n")


def non_empty_coverage(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """By keys: the share of rows with a value (3 digits; a row in error has none), all rows, and those in error. predicted (keys..,
    value, error)."""
    full = F.when(F.col("error").isNull() & (F.coalesce(F.trim("value"), F.lit("")) != ""), 1.0).otherwise(0.0)
    return predicted.groupBy(*keys).agg(F.round(F.avg(full), 3).alias("coverage"), F.count("*").alias("documents"), F.count("error").alias("in_error"))


def totals_from_lines(invoices: DataFrame, lines: DataFrame, least: float = 1000.0, enough: float = 500.0, confidence: float = 0.72) -> DataFrame:
    """Where net_pay is missing or below `least` and the positive line amounts make `enough`, their sum is montant_brut, montant_net,
    montant_ttc and net_pay, and confidence is raised; totals_from_lines tells where. Sums are of cents."""
    total = lines.where("montant_ligne > 0").groupBy(F.col("invoice_id").alias("id")).agg(F.sum(F.col("montant_ligne").cast("decimal(18,2)")).cast("double").alias("_total"))
    use = (F.coalesce("net_pay", F.lit(0.0)) < least) & (F.coalesce("_total", F.lit(0.0)) >= enough)
    j = invoices.join(total, "id", "left").withColumn("totals_from_lines", use)
    kept = {c: F.when(F.col("totals_from_lines"), F.col("_total")).otherwise(F.col(c)) for c in ("montant_brut", "montant_net", "montant_ttc", "net_pay") if c in invoices.columns}
    kept["confidence"] = F.when(F.col("totals_from_lines"), F.greatest("confidence", F.lit(confidence))).otherwise(F.col("confidence"))
    return j.withColumns(kept).drop("_total")


def corrections_per_document(corrections: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """(document_id, corrections, hint): how many, and the validator of the latest one."""
    s = sessions.select(F.col("id").alias("session_id"), "document_id", "validator_id")
    # Counted by session first, so that sessions and users are joined with few rows.
    by_session = corrections.groupBy("session_id").agg(F.count("*").alias("n"), F.max(F.struct("changed_at", "id")).alias("last"))
    j = by_session.join(s, "session_id").join(users.select(F.col("id").alias("validator_id"), "username"), "validator_id", "left")
    out = j.groupBy("document_id").agg(F.sum("n").alias("corrections"), F.max_by("username", "last").alias("by"))
    plural = F.when(F.col("corrections") > 1, "s").otherwise("")
    hint = F.concat(F.col("corrections").cast("string"), F.lit(" correction"), plural, F.coalesce(F.concat(F.lit(" · "), "by"), F.lit("")))
    return out.select("document_id", "corrections", hint.alias("hint"))


def row_counts(tables: dict[str, DataFrame], last: int = 10) -> DataFrame:
    """(source, what, value long): the number of rows of each table (what = 'rows') and its last ids ('id')."""
    parts = []
    for name, df in tables.items():
        row = lambda what, c, name=name: [F.lit(name).alias("source"), F.lit(what).alias("what"), c.cast("long").alias("value")]
        parts += [df.agg(F.count("*").alias("n")).select(*row("rows", F.col("n"))), df.select("id").orderBy(F.desc("id")).limit(last).select(*row("id", F.col("id")))]
    return reduce(DataFrame.unionByName, parts)


# Months on the dashboard.
MONTHS = "Jan Fév Mar Avr Mai Juin Juil Août Sep Oct Nov Déc".split()


def monthly_indicators(declarations: DataFrame, sessions: DataFrame, now: Column, months: int = 6) -> DataFrame:
    """(month, label, created, validated) of the last months to now, such without any too. Only they are read."""
    first = F.date_trunc("month", now)
    oldest = first - F.make_interval(months=F.lit(months - 1))
    month = lambda c: F.date_trunc("month", c).cast("timestamp_ntz").alias("month")
    axis = declarations.sparkSession.range(1).select(F.explode(F.sequence(oldest, first, F.expr("INTERVAL '1' MONTH"))).alias("m")).select(month("m"))
    created = declarations.where(F.col("created_at") >= oldest).groupBy(month("created_at")).agg(F.count("*").alias("created"))
    done = sessions.where((F.col("status") == "validated") & (F.col("ended_at") >= oldest)).groupBy(month("ended_at")).agg(F.count("*").alias("validated"))
    label = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.month("month")), F.year("month").cast("string"))
    return axis.join(created, "month", "left").join(done, "month", "left").select("month", label.alias("label"), F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("validated", F.lit(0)).alias("validated"))


def status_counts(resolved: DataFrame) -> DataFrame:
    """(status, n) of documents with their resolved status."""
    return resolved.groupBy(F.col("resolved").alias("status")).agg(F.count("*").alias("n"))


def declaration_stats(resolved: DataFrame) -> DataFrame:
    """All documents with a resolved status, those validated, those under way, and their owners."""
    r = F.col("resolved")
    return resolved.agg(F.count("*").alias("total"), F.count_if(r == "validated").alias("validated"), F.count_if(r.isin("in_progress", "pending", "processing")).alias("in_progress"), F.count_distinct("user_id").alias("owners"))
