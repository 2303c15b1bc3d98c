"""Relational operators of the library: visibility, latest rows, links, reconciliation, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.scalars import filled, parse_amount, parse_int_amount, plain_number


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. A ranked window with a bound of one is cut down before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def newest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the greatest order, nulls being least: an aggregate with partial maxima, so a key that many rows share
    (a placeholder's id) is one row a task before the shuffle, and no window sorts it."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*key).agg(best).select(*[F.col(c) if c in key else F.col("_r")[c].alias(c) for c in df.columns])


def visible(df: DataFrame, user: int, admin: bool = False, ownerless: bool = False) -> DataFrame:
    own = F.col("user_id") == user
    return df if admin else df.where(own | F.col("user_id").isNull() if ownerless else own)


# Characters of text that are kept, of a declaration and of an invoice.
RAW_TEXT, INVOICE_TEXT = 5000, 120_000


def clamp(df: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """df with its string columns cut to their declared lengths; columns that aren't there are passed over."""
    return df.withColumns({c: F.substring(c, 1, n) for c, n in lengths.items() if c in df.columns})


def known_columns(results: DataFrame, columns: list[str], ignored: tuple[str, ...] = ("taxes", "articles", "flags_validation", "storage", "erreur")) -> DataFrame:
    """Of results only what are columns of the wide table, but for the ignored ones."""
    return results.select(*[c for c in columns if c in results.columns and c not in ignored])


def latest_sessions(sessions: DataFrame) -> DataFrame:
    return newest(sessions, ["document_id"], [F.coalesce("ended_at", "started_at"), -F.col("id")])


def resolved_status(declarations: DataFrame, sessions: DataFrame) -> DataFrame:
    """The latest session's status where it says something, else the document's, else pending."""
    last = latest_sessions(sessions).select(F.col("document_id").alias("id"), F.col("status").alias("session_status"), "validator_id")
    status = F.when(F.col("session_status").isin("validated", "rejected", "in_progress"), F.col("session_status")).otherwise(F.coalesce(filled(F.col("statut")), F.lit("pending")))
    return declarations.join(last, "id", "left").withColumn("resolved", status)


def compare_inputs(declarations: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The values of declarations that invoices are compared with. overrides (dum_id, and any of pfn, declared double, devise,
    numero, mode string, colis int, poids double) go first; a declared amount counts where there is no PFN at all."""
    own = declarations.select(
        F.col("id").alias("dum_id"), filled(F.col("numero")).alias("dum_numero"), F.col("statut").alias("dum_statut"), parse_amount(F.col("montant_ptfn")).alias("pfn"), filled(F.col("devise")).alias("dum_devise"),
        parse_int_amount(F.col("nombre_colis")).alias("dum_colis"), parse_amount(F.col("poids_net")).alias("dum_poids"), filled(F.col("mode_livraison")).alias("dum_mode"))
    if overrides is None:
        return own
    given = overrides.select("dum_id", *[F.col(c).alias(f"o_{c}") for c in overrides.columns if c != "dum_id"])
    names = {"pfn": "pfn", "devise": "dum_devise", "numero": "dum_numero", "colis": "dum_colis", "poids": "dum_poids", "mode": "dum_mode"}
    there = lambda c: filled(F.col(f"o_{c}")) if c in ("devise", "numero", "mode") else F.col(f"o_{c}")
    first = {name: F.coalesce(there(c), F.col(name)) for c, name in names.items() if f"o_{c}" in given.columns}
    if "o_declared" in given.columns:
        first["pfn"] = F.coalesce(first.get("pfn", F.col("pfn")), F.col("o_declared"))
    return own.join(given, "dum_id", "left").withColumns(first).select(own.columns)


# What a control of an invoice leaves on it.
CONTROL = ["numero_declaration_dum", "date_declaration_dum", "montant_declare_dum", "devise_declaree_dum", "ecart_montant", "ecart_commentaire", "statut_controle", "compared_at", "controle_anomalies_json"]


def link_one_to_one(invoices: DataFrame) -> DataFrame:
    """Of the invoices on a declaration the one linked last (of those of one time the one with the largest id) keeps its link; the others
    lose it and the columns of CONTROL. The last of a declaration comes from partial maxima and is joined back, so invoices on one
    placeholder needn't meet in a task."""
    linked = invoices.where("dum_id is not null")
    last = linked.groupBy("dum_id").agg(F.max(F.struct("created_at", "id"))["id"].alias("_last"))
    lost = [c for c in ("dum_id", *CONTROL) if c in invoices.columns]
    kept = linked.join(last, "dum_id").withColumn("_keep", F.col("id") == F.col("_last")).withColumns({c: F.when(F.col("_keep"), F.col(c)) for c in lost})
    return kept.select(invoices.columns).unionByName(invoices.where("dum_id is null"))


# The anomalies of a control, in their order, and what is said about them.
NO_AMOUNT, NO_PFN = "Aucun NET PAY (ni TTC) sur la facture pour comparer.", "PFN article / montant PTFN DUM non fourni."
PRINCIPAL, PACKAGES, WEIGHT, TERMS = "Comparaison principale : NET PAY (facture) vs PFN article (DUM).", "Nombre de colis différent.", "Poids net (kg) différent.", "Incoterm / mode livraison différent."
ALIGNED = "OK — NET PAY facture aligné avec PFN article DUM (tolérance respectée)."


def reconcile(invoices: DataFrame, inputs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Invoices joined with their declarations' values: base, gap, status, comment, and anomalies, an array of (code, severity,
    message, facture_value, dum_value) in a fixed order; codes is the codes alone."""
    tol = tolerance or 0.01
    j = invoices.join(inputs, "dum_id", "left").withColumn("base", F.coalesce("net_pay", "montant_ttc"))
    base, pfn, gap = F.col("base"), F.col("pfn"), F.col("gap")
    usable = base.isNotNull() & pfn.isNotNull()
    j = j.withColumn("gap", F.when(usable, F.round(base - pfn, 4)).otherwise(F.lit(0.0)))
    yes = lambda c: F.coalesce(usable & c, F.lit(False))
    own, theirs = F.coalesce(F.trim(F.upper("devise")), F.lit("")), F.coalesce(F.trim(F.upper("dum_devise")), F.lit(""))
    off, severe = usable & (F.abs(gap) > tol), F.abs(gap) > max(10 * tol, 1.0)
    currency = usable & (own != "") & (theirs != "") & (own != theirs)
    packages, weight = yes(F.col("nombre_colis") != F.col("dum_colis")), yes(F.abs(F.col("poids_net") - F.col("dum_poids")) > 0.5)
    term = lambda c: F.substring(F.trim(F.upper(c)), 1, 3)
    mode = yes((F.col("mode_livraison") != "") & (F.col("dum_mode") != "") & (term("mode_livraison") != term("dum_mode")))
    number = filled(F.col("dum_numero"))
    differ = F.concat(F.lit("Devises différentes : facture="), own, F.lit(", DUM="), theirs, F.lit(" — vérifiez la comparaison."))
    signed = F.format_string("%+.4f", gap)
    wide = F.concat(F.lit("Écart montant "), signed, F.lit(" (facture − DUM PFN)."))
    amount, declared = plain_number(base), plain_number(pfn)
    whole = lambda c: F.col(c).cast("string")

    def anomaly(when: Column, code: str, severity, message, mine: Column, other: Column) -> Column:
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(when, F.struct(F.lit(code).alias("code"), text(severity).alias("severity"), text(message).alias("message"), mine.cast("string").alias("facture_value"), other.cast("string").alias("dum_value")))

    none = F.lit(None)
    found = F.array(
        anomaly(base.isNull(), "invoice_amount_missing", "error", NO_AMOUNT, none, declared),
        anomaly(base.isNotNull() & pfn.isNull(), "dum_pfn_missing", "error", NO_PFN, amount, none),
        anomaly(currency, "currency_mismatch", "warning", differ, own, theirs),
        anomaly(usable, "montant_net_pay_vs_pfn", "info", PRINCIPAL, F.trim(F.concat_ws(" ", amount, own)), F.trim(F.concat_ws(" ", declared, theirs))),
        anomaly(off, "amount_gap", F.when(severe, "error").otherwise("warning"), wide, amount, declared),
        anomaly(usable & ~off & ~currency, "amount_ok", "info", F.concat(F.lit("Écart "), signed, F.lit(f" dans la tolérance ±{tol}.")), amount, declared),
        anomaly(packages, "colis_mismatch", "warning", PACKAGES, whole("nombre_colis"), whole("dum_colis")),
        anomaly(weight, "poids_net_mismatch", "warning", WEIGHT, plain_number(F.col("poids_net")), plain_number(F.col("dum_poids"))),
        anomaly(mode, "incoterm_mismatch", "warning", TERMS, term("mode_livraison"), term("dum_mode")),
        anomaly(usable & number.isNotNull(), "declaration_linked", "info", F.concat(F.lit("Déclaration DUM n° "), number, F.lit(".")), none, number))
    status = F.when(~usable | off & severe, "error").when(off | currency | packages | weight | mode, "warning").otherwise("ok")
    comment = F.when(base.isNull(), "Montant facture manquant").when(pfn.isNull(), "Montant DUM manquant").when(off, wide).when(currency, differ).otherwise(ALIGNED)
    out = j.withColumns({"status": status, "comment": comment, "anomalies": F.filter(found, lambda a: a.isNotNull())})
    return out.withColumn("codes", F.transform("anomalies", lambda a: a["code"]))


def anomaly_rows(reconciled: DataFrame) -> DataFrame:
    """(id, position long, code, severity, message, facture_value, dum_value): the anomalies one by one."""
    return reconciled.select("id", F.posexplode("anomalies").alias("position", "a")).select("id", "position", "a.*")


def amount_aligned(reconciled: DataFrame, tolerance: float = 0.01) -> Column:
    """Whether an amount is aligned: no error, no gap told, NET PAY and PFN near each other; where one is missing, the stored gap, and
    without that the status decides."""
    near = F.when(F.col("net_pay").isNotNull() & F.col("pfn").isNotNull(), F.abs(F.col("net_pay") - F.col("pfn")) <= tolerance)
    stored = F.when(F.col("ecart_montant").isNotNull(), F.abs("ecart_montant") <= tolerance) if "ecart_montant" in reconciled.columns else F.lit(None).cast("boolean")
    return (F.col("status") != "error") & ~F.array_contains("codes", "amount_gap") & F.coalesce(near, stored, F.col("status") == "ok")


def field_f1(truth: DataFrame, predicted: DataFrame, keys: list[str], settings: list[tuple]) -> DataFrame:
    """(keys.., field) with tp, fp, fn, documents, precision, recall, f1, coverage (of documents with a value predicted where one is
    told) for each of the settings, the values of keys that were tried; truth (file, field, value), predicted (keys..,
    file, field, value)."""
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    t = truth.select("file", "field", norm("value").alias("t"))
    p = predicted.select(*keys, "file", "field", norm("value").alias("p"))
    tried = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, s)]) for s in settings])
    wanted = t.withColumn("_s", F.explode(tried)).select("_s.*", "file", "field", "t")
    j = wanted.join(p, [*keys, "file", "field"], "left").withColumn("p", F.coalesce("p", F.lit("")))
    hit, miss = (F.col("t") != "") & (F.col("t") == F.col("p")), (F.col("t") != "") & (F.col("t") != F.col("p"))
    out = j.groupBy(*keys, "field").agg(F.count_if(hit).alias("tp"), F.count_if((miss | (F.col("t") == "")) & (F.col("p") != "")).alias("fp"), F.count_if(miss).alias("fn"), F.count("*").alias("documents"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, documents = F.col("tp"), F.col("fp"), F.col("fn"), F.col("documents")
    scores = {"precision": F.round(ratio(tp, tp + fp), 4), "recall": F.round(ratio(tp, tp + fn), 4), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 4), "coverage": F.round(ratio(tp + fp, documents), 4)}
    return out.withColumns(scores)
