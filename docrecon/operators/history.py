"""Histories of declarations and invoices: owners, partners, corrections, filters, pages, deletions and CSV lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecon.functions.scalars import dum_validated, filled, importer_code, invoice_validated, fold_text, plain_number
from docrecon.operators.core import latest, latest_sessions, newest

# Labels, tones and filter keys of statuses.
DUM_STATUS = {"validated": ("Validé", "success", "validated"), "rejected": ("Rejeté", "danger", "rejected"), "in_progress": ("En cours", "warning", "in_progress"), "processing": ("En cours", "warning", "in_progress")}
OTHER_DUM = ("En attente", "warning", "pending")
INVOICE_STATUS = {"extracted": ("Extrait", "warning", "in_progress"), "valide": ("Validé", "success", "validated"), "controle_croise": ("Contrôlé", "success", "validated")}
CONTROL_WORDS = {"ok": ("OK", "Conforme", "ok"), "warning": ("Attention", "Attention", "warning"), "error": ("Écart", "Écart", "error")}
NONE = "—"
WORDS = r"[\p{L}\p{N}_]+"


def _choose(c: Column, values: dict, at: int, other: Column) -> Column:
    out = other
    for key, row in values.items():
        out = F.when(c == key, row[at]).otherwise(out)
    return out


def _text(x) -> Column:
    return F.col(x).cast("string")


def owner_labels(invoices: DataFrame, traces: DataFrame, users: DataFrame) -> DataFrame:
    """invoices with owner: the latest trace with a username, else the user's name or e-mail, else 'Utilisateur #id', else null."""
    last = newest(traces.where("trim(username) <> ''").select("document_id", "username", "uploaded_at", "id"), ["document_id"], [F.col("uploaded_at"), F.col("id")]).select(F.col("document_id").alias("id"), F.trim("username").alias("_trace"))
    names = users.select(F.col("id").alias("user_id"), F.coalesce(filled(F.col("username")), filled(F.col("email"))).alias("_name"))
    label = F.when(F.col("user_id").isNotNull(), F.concat(F.lit("Utilisateur #"), _text("user_id")))
    return invoices.join(last, "id", "left").join(names, "user_id", "left").withColumn("owner", F.coalesce("_trace", "_name", label)).drop("_trace", "_name")


def correction_timeline(corrections: DataFrame, sessions: DataFrame, fields: DataFrame, users: DataFrame) -> DataFrame:
    """(document_id, position, total, id, field_key, old_value, new_value, action_type, username, changed_at): the corrections of a
    document, the newest at position 1, with the name of the extracted field and of who changed it."""
    s = sessions.select(F.col("id").alias("session_id"), "document_id")
    f = fields.select(F.col("id").alias("extracted_field_id"), "field_key")
    u = users.select(F.col("id").alias("changed_by"), "username")
    j = corrections.drop("field_key").join(s, "session_id").join(f, "extracted_field_id", "left").join(u, "changed_by", "left")
    one = Window.partitionBy("document_id")
    newest = F.row_number().over(one.orderBy(F.desc("changed_at"), F.desc("id")))
    return j.withColumns({"position": newest, "total": F.count("*").over(one)}).select("document_id", "position", "total", "id", "field_key", "old_value", "new_value", "action_type", "username", "changed_at")


def history_rows(declarations: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """The thirteen columns of a declaration in the history. A validation session that says something decides the status."""
    last = latest_sessions(sessions).select(F.col("document_id").alias("id"), F.col("status").alias("_said"), "validator_id", F.col("ended_at").alias("validated_at"))
    owners = users.select(F.col("id").alias("user_id"), F.col("username").alias("owner"))
    validators = users.select(F.col("id").alias("validator_id"), F.col("username").alias("validator"))
    j = declarations.join(last, "id", "left").join(owners, "user_id", "left").join(validators, "validator_id", "left")
    status = F.when(F.col("_said").isin("validated", "rejected", "in_progress"), F.col("_said")).otherwise(F.when(F.col("statut").isin(*DUM_STATUS), F.col("statut")))
    label = F.coalesce(F.nullif("numero", F.lit("")), F.nullif("fichier", F.lit("")), F.concat(F.lit("Document #"), _text("id")))
    return j.select(
        F.col("id").alias("document_id"), label.alias("document"), F.col("numero").alias("numero_declaration"), "date_declaration", "fichier", "owner", F.date_format("created_at", "yyyy-MM-dd").alias("date"), "created_at",
        _choose(status, DUM_STATUS, 0, F.lit(OTHER_DUM[0])).alias("status"), _choose(status, DUM_STATUS, 1, F.lit(OTHER_DUM[1])).alias("tone"), F.col("score_confiance").alias("score"), "validated_at", "validator")


def recent_activity(declarations: DataFrame, sessions: DataFrame, users: DataFrame, limit: int = 5) -> DataFrame:
    """The newest 1 to 20 documents with label, status and owner; only they are joined."""
    top = declarations.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, 20)))
    return history_rows(top, sessions.join(top.select(F.col("id").alias("document_id")), "document_id", "left_semi"), users).select("document_id", "document", "date", "status", "tone", "owner")


def history_items(rows: DataFrame, invoices: DataFrame, corrections: DataFrame) -> DataFrame:
    """Declarations (rows of history_rows) and invoices (with owner) as one table of history items, each with its partner: the
    invoice that is linked last, or the linked declaration. corrections (document_id, corrections)."""
    names = ["id", "numero", "date_facture", "statut", "statut_controle", "compared_at", "montant_declare_dum", "net_pay", "ecart_montant", "devise_declaree_dum", "devise"]
    by_dum = newest(invoices.where("dum_id is not null").select("dum_id", "created_at", *names), ["dum_id"], [F.col("created_at"), F.col("id")])
    linked = by_dum.select(F.col("dum_id").alias("document_id"), *[F.col(c).alias(f"l_{c}") for c in names])
    j = rows.join(linked, "document_id", "left").join(corrections.select("document_id", "corrections"), "document_id", "left")
    has = F.col("l_id").isNotNull()
    word = lambda c, at, other: _choose(c, CONTROL_WORDS, at, F.when(c.isNotNull(), other).otherwise(NONE if at else None))
    one = j.select(
        F.lit("dum").alias("type"), F.lit("DUM").alias("type_label"), F.col("document_id").alias("id"), F.col("document").alias("reference"), F.coalesce("fichier", "document").alias("file_name"), "owner", "created_at", "status",
        _choose(F.col("status"), {v[0]: v for v in DUM_STATUS.values()}, 2, F.lit(OTHER_DUM[2])).alias("filter_key"),
        F.when(has, F.concat(F.lit("Facture "), F.coalesce(F.nullif("l_numero", F.lit("")), F.concat(F.lit("#"), _text("l_id"))))).otherwise(NONE).alias("reconciliation"),
        word(F.col("l_statut_controle"), 1, "Comparé").alias("control_label"), F.when(has, F.coalesce(filled(F.col("l_numero")), F.concat(F.lit("FACT-"), _text("l_id")))).alias("partner_number"), filled(F.col("l_date_facture")).alias("partner_date"),
        F.when(has, invoice_validated(F.col("l_statut"))).alias("partner_validated"), (F.col("l_compared_at").isNotNull() | F.col("l_statut_controle").isNotNull()).alias("reconciled"), F.col("l_statut_controle").alias("control"),
        F.col("l_montant_declare_dum").alias("pfn"), F.col("l_net_pay").alias("net_pay"), F.col("l_ecart_montant").alias("gap"), F.coalesce("l_devise_declaree_dum", "l_devise").alias("currency"), F.col("l_compared_at").alias("compared_at"),
        F.col("document_id").alias("dum_id"), F.col("l_id").alias("invoice_id"), F.coalesce(_text("corrections"), F.lit("0")).alias("corrections"), (F.col("status") == "Validé").alias("validated"))
    dums = rows.select(F.col("document_id").alias("dum_id"), F.col("numero_declaration").alias("d_numero"), F.col("date_declaration").alias("d_date"), F.col("status").alias("d_status"))
    i = invoices.join(dums, "dum_id", "left")
    there, dum = F.col("dum_id").isNotNull(), F.concat(F.lit("DUM #"), _text("dum_id"))
    said = _choose(F.col("statut_controle"), CONTROL_WORDS, 0, F.when(F.col("compared_at").isNotNull(), "Comparé"))
    two = i.select(
        F.lit("invoice").alias("type"), F.lit("Facture").alias("type_label"), "id", F.coalesce(F.nullif("numero", F.lit("")), F.concat(F.lit("FACT-"), _text("id"))).alias("reference"), F.coalesce("fichier", F.lit("")).alias("file_name"), "owner", "created_at",
        _choose(F.col("statut"), INVOICE_STATUS, 0, F.coalesce(F.col("statut"), F.lit("Extrait"))).alias("status"),
        F.when(F.col("compared_at").isNotNull(), "reconciled").otherwise(_choose(F.col("statut"), INVOICE_STATUS, 2, F.lit("in_progress"))).alias("filter_key"),
        F.when(there, F.concat_ws(" · ", dum, said)).otherwise(NONE).alias("reconciliation"), F.when(there, word(F.col("statut_controle"), 1, "Comparé")).otherwise(NONE).alias("control_label"),
        F.when(there, F.coalesce(filled(F.col("numero_declaration_dum")), filled(F.col("d_numero")), dum)).alias("partner_number"), F.when(there, F.coalesce(filled(F.col("date_declaration_dum")), filled(F.col("d_date")))).alias("partner_date"),
        F.when(there, F.coalesce(dum_validated(F.col("d_status")) | (F.col("d_status") == "Validé"), F.lit(False))).alias("partner_validated"), (F.col("compared_at").isNotNull() | F.col("statut_controle").isNotNull()).alias("reconciled"), F.col("statut_controle").alias("control"),
        F.col("montant_declare_dum").alias("pfn"), "net_pay", F.col("ecart_montant").alias("gap"), F.coalesce("devise_declaree_dum", "devise").alias("currency"), "compared_at", "dum_id", F.col("id").alias("invoice_id"), F.lit(NONE).alias("corrections"), invoice_validated(F.col("statut")).alias("validated"))
    return one.unionByName(two)


# The steps import, extraction, validation, reconciliation and export, by the number of those that are done.
def progress(items: DataFrame) -> Column:
    """The states of the five steps of a history item: done ones, the current one, pending ones."""
    validated = F.col("status").isin("Validé", "Contrôlé") | (F.col("filter_key") == "validated")
    done = F.when(~validated & F.col("filter_key").isin("in_progress", "pending"), 2).when(~validated, 1).when(F.col("control").eqNullSafe("ok"), 4).otherwise(3)
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i < done, "done").when(i == done, "current").otherwise("pending"))


def row_actions(items: DataFrame) -> DataFrame:
    """History items with steps and what may be done: show_validation, show_reconcile (a control that isn't ok may be done again; a
    linked partner that isn't validated hides it), report_invoice_id (after a comparison), export_kind (dossier first)."""
    control = F.coalesce("control", F.lit(""))
    reconcile = F.col("validated") & (control != "ok") & (control.isin("warning", "error") | F.coalesce("partner_validated", F.lit(True)))
    report = F.when((control != "") | F.col("reconciled"), F.col("invoice_id"))
    kind = F.when(report.isNotNull(), "dossier").when(F.col("validated"), F.col("type"))
    return items.withColumns({"steps": progress(items), "show_validation": ~F.col("validated"), "show_reconcile": reconcile, "report_invoice_id": report, "export_kind": kind})


def filter_history(items: DataFrame, now: Column, search: str = "", type: str = "all", status: str = "all", days: int = 0) -> DataFrame:
    """History items of a type and status ('in_progress' takes pending ones too, 'reconciled' looks at its flag) of the last `days`
    days that hold `search` in reference, file name, owner, reconciliation or type, whatever the case."""
    out = items if type == "all" else items.where(F.col("type") == type)
    if status == "reconciled":
        out = out.where("reconciled")
    elif status != "all":
        out = out.where(F.col("filter_key").isin(*(["in_progress", "pending"] if status == "in_progress" else [status])))
    if days > 0:
        out = out.where(F.col("created_at") >= now - F.make_interval(days=F.lit(days)))
    if search:
        text = F.concat_ws("\n", "reference", "file_name", "owner", "reconciliation", "type_label")
        out = out.where(F.lower(text).contains(search.lower()))
    return out


def history_totals(items: DataFrame) -> DataFrame:
    """Totals of each side and of both."""
    return items.agg(F.count("*").alias("total"), F.count_if(F.col("type") == "dum").alias("dum_total"), F.count_if(F.col("type") == "invoice").alias("invoice_total"))


def history_stats(items: DataFrame) -> DataFrame:
    """All history items, those validated, those under way, those whose control is right, and those reconciled with a warning or error;
    and their owners."""
    key, control = F.col("filter_key"), F.col("control")
    return items.agg(
        F.count("*").alias("total"), F.count_if(key == "validated").alias("validated"), F.count_if(key.isin("in_progress", "pending")).alias("in_progress"), F.count_if(control == "ok").alias("reconciled_ok"),
        F.count_if(F.col("reconciled") & control.isin("warning", "error")).alias("reconciled_warning"), F.count_distinct("owner").alias("owners"))


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 50) -> tuple[DataFrame, Column]:
    """Rows skip to skip + limit (1 to 200), and how many there are altogether: a column that is counted when it is read."""
    return df.orderBy(*order).offset(max(0, skip)).limit(max(1, min(limit, 200))), df.agg(F.count("*")).scalar()


def deep_page(df: DataFrame, at: str = "created_at", key: str = "id", skip: int = 0, limit: int = 50) -> tuple[DataFrame, int]:
    """page() by time (newest first, unknown last) and key, however deep: rows are counted by day, and only the days that hold the page
    are read and sorted. The driver gets a row a day."""
    skip, limit = max(0, skip), max(1, min(limit, 200))
    days = sorted(((r.day, r.n) for r in df.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or 0), reverse=True)
    before, wanted, passed = 0, [], 0
    for day, n in days:
        if passed + n <= skip:
            before = passed + n
        elif passed < skip + limit:
            wanted.append(day)
        passed += n
    known = [d for d in wanted if d is not None]
    told = F.col(at).cast("date").between(F.lit(known[-1]), F.lit(known[0])) if known else F.lit(False)
    if known:
        # By time, not by day, so that the range reaches the scan.
        told = (F.col(at) >= F.lit(str(known[-1])).cast(df.schema[at].dataType)) & (F.col(at) < F.date_add(F.lit(str(known[0])).cast("date"), 1).cast(df.schema[at].dataType))
    rows = df.where(told | F.col(at).isNull() if None in wanted else told)
    return rows.orderBy(F.desc(at), F.desc(key)).offset(skip - before).limit(limit), passed


def next_page(df: DataFrame, after: tuple | None, at: str = "created_at", key: str = "id", limit: int = 50) -> DataFrame:
    """The page behind the row (time, key) that the page before has ended with, newest first: a filter on the range, no offset. The time of
    after is None where the last row had none."""
    if after is not None:
        time, last = after
        older = F.col(at).isNull() & (F.col(key) < last) if time is None else (F.col(at) < F.lit(time)) | (F.col(at) == F.lit(time)) & (F.col(key) < last) | F.col(at).isNull()
        df = df.where(older)
    return df.orderBy(F.desc(at), F.desc(key)).limit(max(1, min(limit, 200)))


# The headings of the two exports.
HISTORY_HEADINGS = ["Type", "Référence", "Fichier", "Propriétaire", "Date", "Statut", "Réconciliation", "Statut contrôle", "PFN DUM", "NET PAY", "Écart montant", "Devise contrôle", "Date comparaison", "ID DUM", "ID Facture", "Corrections"]
CONTROL_HEADINGS = [h for h in HISTORY_HEADINGS if h not in ("Propriétaire", "Corrections")]


def history_lines(items: DataFrame) -> DataFrame:
    """The 16 columns of the history export as text; what isn't known is a dash; side and row_id tell whose they are. Select CONTROL_HEADINGS for the list of controls."""
    number = lambda c: F.coalesce(plain_number(F.col(c)), F.lit(NONE))
    text = lambda c, other: F.coalesce(F.nullif(_text(c), F.lit("")), F.lit(other))
    at = lambda c: F.coalesce(F.date_format(c, "dd/MM/yyyy HH:mm"), F.lit(NONE))
    values = [F.col("type_label"), F.col("reference"), F.col("file_name"), text("owner", ""), at("created_at"), F.col("status"), F.col("reconciliation"), text("control", NONE), number("pfn"), number("net_pay"), number("gap"), text("currency", NONE), at("compared_at"), text("dum_id", NONE), text("invoice_id", NONE), F.col("corrections")]
    return items.select(F.col("type").alias("side"), F.col("id").alias("row_id"), *[v.alias(h) for v, h in zip(values, HISTORY_HEADINGS)])


def document_detail(documents: DataFrame, users: DataFrame, children: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """documents with uploaded_by (struct or null) and an array for each of children: name -> (rows, their column with the document's id,
    their columns, the first of which orders them). No children: an empty array."""
    out = documents.join(users.select(F.col("id").alias("user_id"), F.struct("id", "username", "email").alias("uploaded_by")), "user_id", "left")
    for name, (rows, key, columns) in children.items():
        grouped = rows.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(grouped, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out


def pairable(declarations: DataFrame, invoices: DataFrame) -> DataFrame:
    """(kind, id, label, sub, linked_suffix, unlinked): validated declarations and invoices that can be paired. The suffix of an
    invoice names the declaration it is on."""
    sub = lambda what, c: F.concat(F.lit(f"Date {what} "), F.coalesce(filled(F.col(c)), F.lit(NONE)))
    label = lambda what, other: F.coalesce(F.concat(F.lit(f"N° {what} "), filled(F.col("numero"))), F.concat(F.lit(f"{other} #"), _text("id")))
    taken = invoices.where("dum_id is not null").select(F.col("dum_id").alias("id"), F.lit(True).alias("taken")).distinct()
    one = declarations.where(dum_validated(F.col("statut"))).join(taken, "id", "left")
    one = one.select(F.lit("dum").alias("kind"), "id", label("déclaration", "DUM").alias("label"), sub("déclaration", "date_declaration").alias("sub"), F.lit("").alias("linked_suffix"), F.col("taken").isNull().alias("unlinked"))
    dums = declarations.select(F.col("id").alias("dum_id"), F.col("numero").alias("d_numero"), F.col("date_declaration").alias("d_date"))
    two = invoices.where(invoice_validated(F.col("statut"))).join(dums, "dum_id", "left")
    number, day = F.coalesce(filled(F.col("d_numero")), filled(F.col("numero_declaration_dum"))), filled(F.col("d_date"))
    suffix = F.coalesce(F.concat_ws(" · ", F.concat(F.lit("liée DUM n° "), number), day), F.lit(""))
    two = two.select(F.lit("invoice").alias("kind"), "id", label("facture", "Facture").alias("label"), sub("facture", "date_facture").alias("sub"), F.when(number.isNotNull(), suffix).otherwise("").alias("linked_suffix"), F.col("dum_id").isNull().alias("unlinked"))
    return one.unionByName(two)


def bulk_delete(asked: DataFrame, documents: DataFrame, user: int, admin: bool = False, most: int = 200) -> DataFrame:
    """(id, outcome deleted, not_found or forbidden): of the requests (position, raw string) the first `most` by position, without
    repeats, those that aren't whole numbers and those below 1."""
    first = asked.orderBy("position").limit(most)
    ids = first.select(F.when(F.trim("raw").rlike(r"^[+-]?[0-9]+$"), F.trim("raw").try_cast("long")).alias("id")).where("id > 0").distinct()
    there = documents.select("id", "user_id", F.lit(True).alias("there"))
    mine = F.lit(admin) | F.coalesce(F.col("user_id") == user, F.lit(False))
    return ids.join(there, "id", "left").select("id", F.when(F.col("there").isNull(), "not_found").when(mine, "deleted").otherwise("forbidden").alias("outcome"))


def survivors(rows: DataFrame, outcome: DataFrame, key: str = "id") -> DataFrame:
    """rows without those of deleted documents: the table itself, or a child table by its document's id."""
    return rows.join(outcome.where("outcome = 'deleted'").select(F.col("id").alias(key)), key, "left_anti")


def referential(entries: DataFrame) -> DataFrame:
    """(code, name) of entries (code, company): normalised, without entries whose key begins with _ or without name; CL<n> answers
    plain <n> too, unless that has an entry of its own after it."""
    kept = entries.where(~F.coalesce(F.col("code"), F.lit("_")).startswith("_") & filled(F.col("company")).isNotNull()).select(F.coalesce(importer_code(F.col("code")), F.upper("code")).alias("code"), F.trim(F.regexp_replace(fold_text(F.col("company")), r"\s+", " ")).alias("name"))
    digits = F.nullif(F.regexp_extract("code", "^CL([0-9]+)$", 1), F.lit(""))
    more = kept.select(digits.alias("code"), "name").where("code is not null").join(kept.select("code"), "code", "left_anti")
    return kept.unionByName(more).groupBy("code").agg(F.max("name").alias("name"))


def lookup_importer(documents: DataFrame, entries: DataFrame, code: str = "code") -> DataFrame:
    """documents with importer_name, by their code as it is or, for CL<n>, by the plain number."""
    known = referential(entries)
    norm = importer_code(F.col(code))
    j = documents.withColumn("_code", norm).join(known.select(F.col("code").alias("_code"), F.col("name").alias("_own")), "_code", "left")
    j = j.withColumn("_code", F.nullif(F.regexp_extract("_code", "^CL([0-9]+)$", 1), F.lit(""))).join(known.select(F.col("code").alias("_code"), F.col("name").alias("_plain")), "_code", "left")
    return j.withColumn("importer_name", F.coalesce("_own", "_plain")).drop("_code", "_own", "_plain")


def line_contexts(pages: DataFrame, kinds: dict[str, str], before: int = 8, last: int = 450) -> DataFrame:
    """(doc_id, n, line, kind, before_words, before_excerpt): lines of pages (doc_id, text) that match one of kinds (name -> pattern, the
    first that matches), with the up to `before` non-empty lines that come before."""
    kind = lambda c: F.coalesce(*[F.when(c.rlike(pattern), name) for name, pattern in kinds.items()])
    # Texts without a match have no lines to look at. Lines stay in their text: no shuffle, no window.
    lines = F.filter(F.transform(F.split(F.when(kind(F.col("text")).isNotNull(), F.col("text")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    hits = F.filter(F.transform("_lines", lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"), kind(x).alias("kind"))), lambda h: h["kind"].isNotNull())
    told = F.transform(hits, lambda h: F.struct(h["n"].cast("long").alias("n"), F.substring(h["line"], 1, 220).alias("line"), h["kind"].alias("kind"), F.array_join(F.slice("_lines", F.greatest(h["n"] - before, F.lit(1)), F.least(h["n"] - 1, F.lit(before))), " ").alias("before")))
    c = pages.select("doc_id", lines.alias("_lines")).where("_lines is not null").select("doc_id", F.explode_outer(told).alias("c")).where("c is not null").select("doc_id", "c.*")
    return c.select("doc_id", "n", "line", "kind", F.regexp_count("before", F.lit(WORDS)).cast("long").alias("before_words"), F.right("before", F.lit(last)).alias("before_excerpt"))


def heavy_pages(pages: DataFrame, most: int = 20) -> DataFrame:
    """The pages with the most words."""
    return pages.select("doc_id", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")).orderBy(F.desc_nulls_last("words"), "doc_id").limit(most)


def long_contexts(contexts: DataFrame, least: int = 45, most: int = 80) -> DataFrame:
    """The contexts with the most words before them, `least` at least."""
    return contexts.where(F.col("before_words") >= least).orderBy(F.desc("before_words"), "doc_id", "n").limit(most)


def article_dedupe(articles: DataFrame, by_value: bool = False) -> DataFrame:
    """Of article rows (doc, place, num_ligne, code_hs, total_ligne) with the same line and HS code (and value) the first, by place."""
    key = ["doc", "num_ligne", "code_hs", *(["total_ligne"] if by_value else [])]
    return latest(articles, key, [F.col("place")])
