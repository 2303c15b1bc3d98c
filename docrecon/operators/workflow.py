"""Corrections, comparison tables and scores of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecon.functions.scalars import filled, parse_amount

# The known declaration types and currencies.
TYPES = ["DAE", "EA", "SE", "EE", "DUM", "IM", "IM4", "IM6", "EX", "EX1", "EX3", "T1"]
CURRENCIES = ["USD", "EUR", "GBP", "TND", "CHF", "JPY", "CAD"]
# The forms of a number, a date, a type and an authentication key.
NUMBER, DATE, KEY = r"^[0-9]{6}$", r"[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}", r"^D[0-9]{2,6}[A-Z]{2,4}[0-9][A-Z]$"
TYPE = r"^(EA|SE|EE|DUM|IM[0-9]*|EX[0-9]*|T1)$"
LONG_KEY = r"D[0-9]{4}[A-Z]{2,4}[0-9][A-Z]\s*/\s*[0-9]{6,12}"


def diff_fields(stored: DataFrame, submitted: DataFrame) -> DataFrame:
    """(id, field_key, old_value, new_value, action_type) of the submitted values (id, field_key, value) that differ from the
    stored ones after trimming. A null submitted value means that the field wasn't sent."""
    old, new = F.coalesce(F.trim("old_value"), F.lit("")), F.trim("new_value")
    j = submitted.where("value is not null").withColumnRenamed("value", "new_value").join(stored.withColumnRenamed("value", "old_value"), ["id", "field_key"], "left")
    action = F.when(old == "", "add").when(new == "", "delete").otherwise("update")
    return j.where(old != new).select("id", "field_key", "old_value", "new_value", action.alias("action_type"))


def apply_corrections(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """The stored values (id, field_key, value) with the changes of diff_fields; fields that weren't there are manually added."""
    j = stored.join(changes.select("id", "field_key", "new_value", "action_type"), ["id", "field_key"], "full")
    return j.select("id", "field_key", F.coalesce("new_value", "value").alias("value"), F.coalesce(F.col("action_type") == "add", F.lit(False)).alias("manually_added"))


def patch_lines(lines: DataFrame, supplied: DataFrame) -> DataFrame:
    """Invoices with supplied lines have only those; the others keep theirs."""
    return lines.join(supplied.select("invoice_id").distinct(), "invoice_id", "left_anti").unionByName(supplied)


def _same(a: Column, b: Column, equal: Column, anomaly: Column) -> Column:
    return F.when(anomaly, "warning").when(a.isNull() | b.isNull(), "neutral").when(equal, "ok").otherwise("warning")


def patch_columns(invoices: DataFrame, patches: DataFrame) -> DataFrame:
    """invoices with the columns of patches (id, provided: the names that are supplied, and columns), null where null is supplied."""
    names = [c for c in patches.columns if c in invoices.columns and c != "id"]
    j = invoices.join(patches.select("id", "provided", *[F.col(c).alias(f"_new_{c}") for c in names]), "id", "left")
    given = lambda c: F.coalesce(F.array_contains("provided", c), F.lit(False))
    return j.withColumns({c: F.when(given(c), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in names}).select(invoices.columns)


# What a session's status is called, and the status that it gives its document.
SESSION_WORDS = {"validated": "validated", "valide": "validated", "rejected": "rejected", "rejete": "rejected"}


def corrected_documents(documents: DataFrame, changes: DataFrame, sessions: DataFrame) -> DataFrame:
    """documents (id, statut, raw_json: an object) after sessions (id, status): status and raw JSON are written back, with the new
    values of changes (diff_fields); corrections is their number. Documents without a session stay as they are."""
    word = F.lower(F.trim("status"))
    status = F.coalesce(*[F.when(word == said, name) for said, name in SESSION_WORDS.items()], F.lit("processing"))
    per = changes.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_key", "new_value")))).alias("_new"), F.count("*").alias("_n"))
    j = documents.join(sessions.select("id", status.alias("_status")), "id", "left").join(per, "id", "left")
    old = F.coalesce(F.from_json("raw_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    merged = F.when(F.col("_new").isNotNull(), F.to_json(F.map_concat(kept, "_new"))).otherwise(F.col("raw_json"))
    return j.withColumns({"statut": F.coalesce("_status", "statut"), "raw_json": merged, "corrections": F.coalesce("_n", F.lit(0))}).drop("_status", "_new", "_n")


def comparison_rows(reconciled: DataFrame) -> DataFrame:
    """(id, code, position, tone, category, dum_value, invoice_value, label): nine rows for each reconciled invoice, in their fixed order."""
    return reconciled.select("id", F.inline(comparison(reconciled)))


def issues_of(reconciled: DataFrame) -> DataFrame:
    """reconciled with issues, how many of the nine rows are errors or warnings, and aligned, whether the amounts' row is fine."""
    rows = reconciled.withColumn("_rows", comparison(reconciled))
    count = F.size(F.filter("_rows", lambda r: r["tone"].isin("error", "warning"))).cast("long")
    return rows.withColumns({"issues": count, "aligned": F.col("_rows")[0]["tone"] == "ok"}).drop("_rows")


# The categories of the rows and the words for their tones.
CATEGORIES = ["NET PAY vs PFN (DUM)", "Devise", "Nombre de colis", "Poids net (kg)", "Incoterm / livraison", "N° déclaration (DUM)", "Date déclaration (DUM)", "N° facture", "Date facture"]
TONES = {"ok": "Conforme", "warning": "Attention", "error": "Écart", "neutral": "—"}


def comparison(reconciled: DataFrame) -> Column:
    """The nine rows as an array."""
    c, has = F.col, lambda code: F.array_contains("codes", code)
    aligned = F.coalesce((c("status") != "error") & ~has("amount_gap") & c("base").isNotNull() & c("pfn").isNotNull() & (F.abs("gap") <= 0.01), F.lit(False))
    there = lambda name: F.when(c(name).isNotNull(), "ok").otherwise("neutral")
    differ = F.coalesce(has("currency_mismatch") | (filled(F.upper("devise")) != filled(F.upper("dum_devise"))), F.lit(False))
    tones = {
        "montant_net_pay_vs_pfn": F.when(aligned, "ok").when(has("amount_gap") & (F.abs("gap") > 1.0), "error").otherwise("warning"),
        "currency_mismatch": F.when(differ, "warning").otherwise("ok"),
        "colis_mismatch": _same(c("nombre_colis"), c("dum_colis"), c("nombre_colis") == c("dum_colis"), has("colis_mismatch")),
        "poids_net_mismatch": _same(c("poids_net"), c("dum_poids"), F.abs(c("poids_net") - c("dum_poids")) < 0.01, has("poids_net_mismatch")),
        "incoterm_mismatch": _same(c("mode_livraison"), c("dum_mode"), F.upper(F.trim("mode_livraison")) == F.upper(F.trim("dum_mode")), has("incoterm_mismatch")),
        "declaration_number": there("dum_numero"), "declaration_date": there("dum_date"), "invoice_number": there("numero"), "invoice_date": there("created_at"),
    }
    dash = lambda x: F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit("—"))
    values = [(c("pfn"), c("net_pay")), (c("dum_devise"), c("devise")), (c("dum_colis"), c("nombre_colis")), (c("dum_poids"), c("poids_net")), (c("dum_mode"), c("mode_livraison")), (c("dum_numero"), F.lit(None)), (c("dum_date"), F.lit(None)), (F.lit(None), c("numero")), (F.lit(None), c("created_at"))]
    label = lambda tone: F.coalesce(*[F.when(tone == k, v) for k, v in TONES.items()])
    return F.array(*[
        F.struct(F.lit(code).alias("code"), F.lit(i).alias("position"), tone.alias("tone"), F.lit(CATEGORIES[i - 1]).alias("category"), dash(values[i - 1][0]).alias("dum_value"), dash(values[i - 1][1]).alias("invoice_value"), label(tone).alias("label"))
        for i, (code, tone) in enumerate(tones.items(), 1)])


def score_declaration(headers: DataFrame) -> DataFrame:
    """headers with score (0 to 100 of 16 points), flags (the failed checks, in order) and quality."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    gross, net = parse_amount(F.col("gross")), parse_amount(F.col("net"))
    weighed = gross.isNotNull() & net.isNotNull()
    checks = {
        "number": (text("number").rlike(NUMBER), 3), "date": (text("date").rlike(DATE), 2), "type": (F.regexp_replace(F.upper(text("type")), "[. ]", "").isin(TYPES), 2),
        "currency": (F.upper(F.trim(text("currency"))).isin("", *CURRENCIES), 2), "exporter": (F.length(F.regexp_replace(text("exporter"), "[^A-Za-z]", "")) >= 5, 2),
        "importer": (F.length(F.trim(text("importer"))) >= 5, 2), "weights": (weighed & (gross >= net), 1), "office": (text("office") != "", 1), "auth_key": (F.upper(text("auth_key")).rlike(KEY), 1),
    }
    points = sum((F.when(ok, weight).otherwise(0) for ok, weight in checks.values()), F.lit(0))
    # Weights that can't be read give no point, but aren't a failed check.
    failed = F.array(*[F.when(~ok & (weighed if name == "weights" else F.lit(True)), name) for name, (ok, _) in checks.items()])
    total = sum(weight for _, weight in checks.values())
    out = headers.withColumns({"score": F.bround(points * 100 / total, 0).cast("int"), "flags": F.filter(failed, lambda f: f.isNotNull())})
    return out.withColumn("quality", F.when(F.col("score") >= 80, "HAUT").when(F.col("score") >= 50, "MOYEN").otherwise("BAS"))


def field_confidences(headers: DataFrame) -> DataFrame:
    """headers with confidence, a map from field to 0..95 by the form of its value."""
    text = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    number = r"^[0-9]+([.,][0-9]+)?$"
    forms = {
        "number": (text("number").rlike(NUMBER), 95, 35), "date": (text("date").rlike(f"^{DATE}$"), 90, 45), "type": (F.upper(text("type")).rlike(TYPE), 88, 40),
        "importer": (F.length(F.regexp_replace(text("importer"), "[^A-Za-z]", "")) >= 6, 78, 45), "gross": (text("gross").rlike(number), 80, 50), "net": (text("net").rlike(number), 80, 50),
        "auth_key": (F.upper(text("auth_key")).rlike(KEY) | F.upper(text("auth_key")).rlike(LONG_KEY), 92, 35),
        "duty_code": (F.lit(True), 65, 65), "duty_total": (text("duty_total").rlike(number), 80, 50),
    }
    forms = {name: form for name, form in forms.items() if name in headers.columns}
    pairs = [x for name, (good, high, low) in forms.items() for x in (F.lit(name), F.when(text(name) == "", 0).when(good, high).otherwise(low))]
    return headers.withColumn("confidence", F.create_map(*pairs))


def mean_confidence(confidence: Column, score: Column) -> dict[str, Column]:
    """mean of a map of confidences, or the document's score where there are none; and rounded, half up."""
    values = F.map_values(confidence)
    mean = F.coalesce(F.when(F.size(values) > 0, F.aggregate(values, F.lit(0), lambda a, x: a + x) / F.size(values)), score.cast("double"))
    return {"mean": mean, "rounded": F.floor(mean + 0.5).cast("int")}


# The keys of an extraction result that become rows.
EXTRACTED = """exportateur adresse_exportateur code_exportateur importateur adresse_importateur code_importateur declarant repertoire numero_credit numero_declaration date_declaration type_declaration nbre_articles
numero_dae nombre_articles nombre_colis exportateur_nom exportateur_code importateur_nom importateur_pays declarant_code declarant_nom transport_international_nationalite transport_international_mode
transport_international_identite transport_national_nationalite transport_national_mode mode_transport date_arrivee_depart pays_provenance pays_destination pays_achat pays_premiere_destination pays_destination_finale
adresse_entreposage mode_livraison devise montant_ptfn mode_paiement relation_acheteur_vendeur engagement valeur_totale assurance fret valeur_dinars engag_c solde_autres_elements_ptfn cours_conversion_zone
valeur_fob_dt taux_conversion designation_marchandises poids_brut poids_net numero_article code_sh_ndp code_pays_origine valeur_prise_en_charge code_qcs qcs pfn qualite_fiscale regime_douanier imposition_speciale
code_titre_ce numero_titre_ce code_regime_precedent code_regime_financier code_regime_transit code_delai code_oci regime valeur_fob douane coefficient_ajustement description_marchandise bureau_frontiere destination
localisation_export bureau_douane code_bureau designation_bureau code_taxe assiette quotite montant code_gdt montant_liquidation montant_total total totaux itineraire certificat_decharge numero_escale rubrique
commissaire_douane texte_engagement nom_declarant date_validation cachet num_agrement num_repertoire cle_authentification score_confiance qualite qr_code""".split()


def fields_to_long(results: DataFrame, keys: list[str] = EXTRACTED) -> DataFrame:
    """(id, field_key, value): the keys that results has, trimmed, without blank ones."""
    there = [k for k in keys if k in results.columns]
    wide = results.select("id", *[F.trim(F.col(k).cast("string")).alias(k) for k in there])
    return wide.unpivot("id", there, "field_key", "value").where("value <> ''")


def export_target(dossier: Column, declaration: Column, invoice: Column) -> Column:
    """What a history row exports: the compared dossier before the validated declaration before the validated invoice."""
    return F.when(dossier, "dossier").when(declaration, "dum").when(invoice, "invoice")


def export_gate(kind: Column, status: Column, aligned: Column, admin: Column) -> Column:
    """A dossier goes only with aligned amounts; its errors need an administrator, and errors and warnings a confirmation of
    their own; everything else the plain confirmation."""
    of_dossier = F.when(~aligned, "refused").when((status == "error") & ~admin, "admin_only").when(status == "error", "confirm_critical").when(status == "warning", "confirm_attention").otherwise("confirm")
    return F.when(kind == "dossier", of_dossier).otherwise("confirm")


def export_payloads(invoices: DataFrame, declarations: DataFrame, users: DataFrame, at: str, fields: list[str], kind: str = "dossier") -> DataFrame:
    """invoices with payload_json: version, kind, reference, exporter (users: user_id, exported_by struct), the declaration's
    columns, the invoice's `fields` and the outcome of its control. A missing declaration or exporter is null."""
    snapshot = declarations.select(F.col("id").alias("dum_id"), F.struct(*declarations.columns).alias("dum"))
    nobody = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in users.schema["exported_by"].dataType.fields])
    control = F.struct("statut_controle", "ecart_montant", "ecart_commentaire", "montant_declare_dum", "numero_declaration_dum", "date_declaration_dum")
    payload = F.struct(
        F.lit("1.0").alias("schema_version"), F.lit(kind).alias("kind"), F.col("numero").alias("reference"), F.lit(at).alias("exported_at"), F.coalesce("exported_by", nobody).alias("exported_by"),
        "dum", F.struct(*fields).alias("invoice"), control.alias("controle"))
    return invoices.join(snapshot, "dum_id", "left").join(users, "user_id", "left").withColumn("payload_json", F.to_json(payload, {"ignoreNullFields": "false"}))


def migration_log(exports: DataFrame, now: Column, prefix: str) -> DataFrame:
    """Rows for the log of migrations, which the sink appends: exports (export_id, kind, reference, payload, payload_reference)
    with success (the payload isn't empty), message, erp_reference and the status that goes back to the export."""
    full = F.coalesce(F.col("payload") != "", F.lit(False))
    name = F.coalesce(filled(F.col("reference")), filled(F.col("payload_reference")), F.concat(F.lit("EXP-"), F.col("export_id").cast("string")))
    reference = F.concat_ws("-", F.lit(prefix), F.upper(F.coalesce("kind", F.lit("dossier"))), F.col("export_id").cast("string"), F.date_format(now, "yyyyMMdd"))
    message = F.when(full, F.concat(F.lit("Migration ERP simulée réussie ("), name, F.lit(")."))).otherwise("Payload ERP vide.")
    return exports.withColumns({"success": full, "erp_reference": F.when(full, reference), "message": message, "migrated_at": now, "status": F.when(full, "migration_ok").otherwise("migration_failed")})
