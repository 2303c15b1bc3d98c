"""Rules for values of single fields: kinds and their shapes, labels and their likeness, cells of templates, aliases, profiles of texts.

What a rule needs to know is a small table of fixed values; tables of fields are joined (their size is that of the table below),
cascades of columns tell the rest.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docrecon.functions.scalars import clean_amount, filled, fold_text, normalize_date, valid_field
from docrecon.operators.extraction import COUNTRIES, DAY, found, party_score, printed_box, route

# The kind, the profile and the page mode of each field.
PROFILES = """
numero_declaration declaration_id numeric 7
date_declaration date_tn numeric 7
type_declaration type_declaration numeric 7
nbre_articles small_int numeric 7
nombre_colis colis numeric 7
exportateur_code alnum_code code 7
declarant_code declarant_code numeric 7
num_repertoire repertoire numeric 7
bureau_frontiere small_int numeric 7
destination small_int numeric 7
poids_brut weight numeric 7
poids_net weight numeric 7
qualite_fiscale non_empty numeric 7
code_regime_financier regime_delai numeric 7
code_delai regime_delai numeric 7
regime regime_delai numeric 7
valeur_fob amount numeric 7
douane amount numeric 7
coefficient_ajustement amount numeric 7
exportateur_area name_block - 6
exportateur_nom name_block - 6
adresse_exportateur address_block - 7
importateur_nom name_block - 6
adresse_importateur address_block - 6
adresse_entreposage address_block - 6
declarant_nom name_block - 7
adresse_declarant address_block - 6
code_importateur alnum_code code 7
engagement_date date_tn numeric 7
pays_provenance country - 6
pays_achat country - 6
pays_premiere_destination country - 6
pays_destination_finale country - 6
block_transport block_text block 6
block_conditions block_text block 6
block_finances block_text block 6
block_article_1 block_text block 6
block_liquidation block_text block 6
code_titre_ce_cell non_empty numeric 7
numero_titre_ce_cell non_empty numeric 7
"""
# Parts of names of fields with digits, and words and countries that values have or must not have.
DIGITS = ["code", "numero", "num_", "repertoire", "colis", "gdt", "qcs", "delai", "regime", "poids", "nbre_", "destination", "bureau_frontiere"]
FORBIDDEN = r"(?i)\b(?:DECLARANT|D[ÉE]CLARANT|CLARANT|CODE|N[°O]|NUMERO|REPERTOIRE|PERTOIRE|CREDIT|N\s*CREDIT)\b"
KNOWN_COUNTRY = r"\b(TN|DE|FR|US|IT|ES|BE|CN|TR|NL|GB|PT|ET|CY|MA|DZ|LY|EG|SD)\b|(?i)\b(?:ETHIOPIE|ETHIOPI|TUNISIE|ALLEMAGNE|FRANCE)\b"
NAMES = ["importateur_nom", "declarant_nom", "exportateur_nom", "importateur", "declarant", "nom_declarant"]
PLACES = ["pays_provenance", "pays_achat", "pays_premiere_destination", "pays_destination_finale", "pays_destination"]


def field_profiles(spark: SparkSession) -> DataFrame:
    """(field_key, kind, profile, psm): the fields whose kind is told."""
    rows = [(f, kind, None if profile == "-" else profile, int(psm)) for f, kind, profile, psm in (x.split() for x in PROFILES.strip().splitlines())]
    return spark.createDataFrame(rows, "field_key string, kind string, profile string, psm int")


def inferred_profile(key: Column, psm: Column) -> Column:
    """The profile of a field that isn't told, by parts of its name."""
    name = F.lower(F.coalesce(key, F.lit("")))
    return F.when(name.rlike("|".join(DIGITS)), "numeric").when(psm.isin(7, 8), "short_text").when(name.startswith("block_"), "block").otherwise("general")


def inferred_kind(key: Column, profile: Column) -> Column:
    """The kind of a field that isn't told, by its profile and parts of its name; the first part that fits counts."""
    name = F.lower(F.coalesce(key, F.lit("")))
    number = F.when(name.contains("date"), "date_tn").when(name == "numero_declaration", "declaration_id").when(name.contains("colis"), "colis").when(name.contains("repertoire"), "repertoire").when(name.contains("poids"), "weight").when(name.rlike("regime|delai"), "regime_delai").otherwise("non_empty")
    return F.when(profile == "numeric", number).when(profile == "block", "block_text").when(name.startswith("pays_"), "country").when(name.rlike("adresse|address"), "address_block").when(name.rlike("nom|importateur|exportateur|declarant"), "name_block").otherwise("non_empty")


def coherent(key: Column, value: Column) -> Column:
    """Whether a value can be that of its field: packages, names, countries and short codes are tested, others just not blank."""
    text, name = F.trim(F.coalesce(value, F.lit(""))), F.lower(F.coalesce(key, F.lit("")))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    test = (
        F.when(name == "nombre_colis", text.rlike(r"^(?!0+$)\d{1,3}$")).when(name.isin(NAMES), (letters >= 5) & ~text.rlike(FORBIDDEN)).when(name.isin(PLACES), text.rlike(KNOWN_COUNTRY))
        .when(name.isin("code_regime_financier", "code_delai"), text.rlike(r"^\d{1,2}$")).otherwise(True)
    )
    return (text != "") & test


def validated(values: DataFrame, psm: int = 6) -> DataFrame:
    """values (.., field_key, value) with kind, profile and valid: by the table of fields, which is joined, else by the name. Null and
    blank values are never valid."""
    key, value = F.col("field_key"), F.col("value")
    text = F.trim(F.coalesce(value, F.lit("")))
    out = values.join(F.broadcast(field_profiles(values.sparkSession).withColumnsRenamed({"kind": "_kind", "profile": "_profile"}).drop("psm")), "field_key", "left")
    told = F.col("_kind").isNotNull()
    guess = inferred_profile(key, F.lit(psm))
    out = out.withColumns({"kind": F.when(told, F.col("_kind")).otherwise(inferred_kind(key, guess)), "profile": F.when(told, F.col("_profile")).otherwise(F.when(guess.isin("numeric", "block"), guess))})
    kind = F.col("kind")
    length = lambda c: F.length(F.regexp_replace(text, c, ""))
    plain = ~text.rlike(FORBIDDEN)
    test = (
        F.when(kind == "name_block", F.when(F.lower(key).isin(NAMES), coherent(key, value)).otherwise((length("[^A-Za-z]") >= 5) & plain))
        .when(kind == "address_block", (key.isNotNull() & (key != "") & coherent(key, value)) | (length("[^A-Za-z0-9]") >= 8) & plain)
        .when(kind == "country", coherent(F.coalesce(F.nullif(key, F.lit("")), F.lit("pays_provenance")), value)).otherwise(valid_field(kind, value))
    )
    return out.withColumn("valid", (text != "") & test).drop("_kind", "_profile")


# The readings of each label.
ANCHORS = {
    "exportateur": ["EXPORTATEUR", "XPORTAT", "EXPORTATEU"], "importateur": ["IMPORTATEUR", "MPORTAT", "LMPORTATEUR"], "declarant": ["DECLARANT", "DECLAR", "DCLARANT"], "colis": ["COLIS", "NBRECOLIS", "NOMBRECOLIS"], "provenance": ["PROVENANCE"], "achat": ["ACHAT"],
    "premiere_destination": ["PREMIEREDESTINATION", "PREMIEREDESTINAT", "1EREDESTINATION"], "destination_finale": ["DESTINATIONFINALE", "DESTINATIONDEFINITIVE", "DESTINATIONDEFINIT"], "regime_financier": ["REGLEMENTFINANCIER", "CREG", "REGIMEFINANCIER"], "delai": ["DELAI", "CDELAI"],
    "transport": ["MOYENDETRANSPORT", "TRANSPORT"], "livraison": ["LIVRAISON"],
}
LEAST_LIKENESS = 0.74


def likeness_bound(token: Column, variant: str) -> Column:
    """What the likeness of a token to a variant can be at most: twice the letters that both have, over both lengths."""
    both = sum((F.least(F.lit(variant.count(c)), F.length(token) - F.length(F.replace(token, F.lit(c), F.lit("")))) for c in sorted(set(variant))), F.lit(0))
    return 2.0 * both / (F.length(token) + len(variant))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def anchor_pairs(tokens: DataFrame, variants: list[str], least: float = LEAST_LIKENESS) -> DataFrame:
    """(token, variant): of the distinct tokens that hold no variant, those that may be like one, to `least` at least. Only these are
    compared."""
    t = F.col("token")
    holds = F.exists(F.array(*map(F.lit, variants)), lambda v: t.contains(v))
    tried = F.array(*[F.when(likeness_bound(t, v) >= least, F.lit(v)) for v in variants])
    return tokens.where(t.isNotNull() & (t != "")).select("token").distinct().where(~holds).select("token", F.explode_outer(F.filter(tried, lambda v: v.isNotNull())).alias("variant")).where("variant is not null")


def anchor_scores(tokens: DataFrame, variants: list[str], least: float = LEAST_LIKENESS) -> DataFrame:
    """tokens (.., token) with score: 1 where a variant is in the token, else the best ratio of equal runs with one of them; 0 where that
    is below `least`, and for null and empty tokens. Each distinct token is compared once, if its letters allow it."""
    best = anchor_pairs(tokens, variants, least).withColumn("r", _ratio("token", "variant")).groupBy("token").agg(F.max("r").alias("_best")).where(F.col("_best") >= least)
    holds = F.coalesce(F.exists(F.array(*map(F.lit, variants)), lambda v: F.col("token").contains(v)), F.lit(False))
    return tokens.join(best, "token", "left").withColumn("score", F.when(holds, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))).drop("_best")


# The phrases of a document's profile, in the order in which they decide. A declaration's words may have their accents.
PHRASES = {"dum_detail": r"D[EÉ]CLARATION EN D[EÉ]TAIL", "sa_number": r"\bSA\s*\d{5,7}\b", "discharge": "C[EÉ]RTIFICAT D[EÉ] D[EÉ]CHARG[EÉ]", "tunisia_customs": "DOUANES TUNISIENNES"}
PROFILE_OF = {"dum_detail": "dum_detail", "sa_number": "sa_text", "discharge": "sa_text", "tunisia_customs": "tunisia_customs"}


def text_profile(text: Column) -> Column:
    """struct(letters, enough, hits, profile) of a document's text: letters and digits, whether they are 400 or more, how often each phrase
    stands in it (one run over the text for all of them), and the profile by the first phrase that does."""
    n = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))
    hits = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit("|".join(PHRASES.values())), F.lit(0))
    # A mixed spelling of the first phrase isn't one.
    kind = lambda h: F.when(h.isin("DECLARATION EN DETAIL", "DÉCLARATION EN DÉTAIL"), "dum_detail").when(h.startswith("SA"), "sa_number").when(h.startswith("DOUANES"), "tunisia_customs").when(h.rlike("CHARG"), "discharge")
    kinds = F.filter(F.transform(hits, kind), lambda k: k.isNotNull())
    number = lambda phrase: F.size(F.filter(kinds, lambda k: k == phrase))
    counts = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, PHRASES)), F.array(*map(number, PHRASES))), lambda k, v: v > 0)
    profile = F.coalesce(*[F.when(F.array_contains(kinds, p), PROFILE_OF[p]) for p in PHRASES], F.lit("unknown"))
    return F.struct(n.cast("long").alias("letters"), (n >= 400).alias("enough"), counts.alias("hits"), profile.alias("profile"))


def form_case(value: Column, extra: list[str] | None = None) -> Column:
    """Whether a value is a number printed on the form's boxes, or one of extra."""
    token = F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", "")
    return (token != "") & (token.rlike(r"^\d{1,2}$") & printed_box(F.when(token.rlike(r"^\d{1,2}$"), token)) | token.isin(*(extra or [""])))


def small_code(value: Column) -> Column:
    """Whether a value is a code from 1 to 9."""
    token = F.trim(F.coalesce(value, F.lit("")))
    return token.rlike(r"^0*[1-9]$")


def cell_number(value: Column, low: int, high: int, boxes: bool = True, last: bool = True) -> Column:
    """The last (or first) number of one to six digits in a cell that is in bounds, and none of the form's boxes unless they may be."""
    tokens = F.regexp_extract_all(value, F.lit(r"\b(\d{1,6})\b"), F.lit(1))
    good = F.filter(F.reverse(tokens) if last else tokens, lambda t: t.cast("int").between(low, high) & (~printed_box(t) if boxes else F.lit(True)))
    return F.get(good, F.lit(0)).cast("int").cast("string")


def country_in(text: Column) -> Column:
    """The first country, in the order of the list, whose code or name is in a text, as `code name`."""
    return country_in_folded(fold_text(text))


def country_in_folded(t: Column) -> Column:
    for misread, right in (("U S A", "USA"), ("U.S.A", "USA"), ("1N", "TN"), ("TM", "TN")):
        t = F.replace(t, F.lit(misread), F.lit(right))
    t = F.get(F.filter(F.array(t), lambda x: x.isNotNull()), F.lit(0))
    name = lambda n: n.replace(" ", r"\s+")
    return F.get(F.transform(F.array(t), lambda x: F.coalesce(*[F.when(x.rlike(rf"\b(?:{c}|{name(n)})\b"), F.lit(f"{c} {n}")) for c, n in COUNTRIES.items()])), F.lit(0))


def exporter_code(value: Column) -> Column:
    """An exporter's code without blanks; a misread O or 0 before its last W goes; null for blank."""
    raw = F.nullif(F.upper(F.regexp_replace(value, r"\s+", "")), F.lit(""))
    return F.when(raw.rlike(r"^\d{6,8}[O0]?W$"), F.regexp_replace(raw, r"^(\d{6,8})[O0]?W$", "$1W")).otherwise(raw)


def preferred_party(current: Column, new: Column) -> Column:
    """Which of two readings of a party's line counts: the new one if it is eight points better, or the current one has less than none."""
    old, fresh = party_score(current), party_score(new)
    better = F.when(F.coalesce(F.trim(new), F.lit("")) == "", False).when(F.coalesce(F.trim(current), F.lit("")) == "", True).when((fresh < 0) & (old >= 0), False).when((old < 0) & (fresh >= 0), True).otherwise(fresh > old + 8)
    return F.when(better, new).otherwise(current)


# Cells of templates by the family of their field, words that aren't in a name, other names of a field.
COUNTS, BUREAUS = {"nbre_articles": 99, "nombre_articles": 99, "nombre_colis": 999}, ["code_gdt", "code_bureau"]
NUMBERS, BOXED = ["bureau_frontiere", "destination", "poids_brut", "poids_net", "qualite_fiscale", "code_regime_financier", "code_delai"], ["poids_brut", "poids_net", "qualite_fiscale"]
AMOUNTS = ["montant_ptfn", "valeur_fob_dt", "valeur_dinars", "taux_conversion", "montant_liquidation"]
POLLUTED = "DECLARANT|ADRESSE|PAYS DE|MOYEN DE|CODE |NUMERO|DATE"
KINDS_OF_DECLARATION = r"\b(EA|SE|EE|DUM|IM\d*|EX\d*|T1)\b"
ALSO = {"exportateur": ["exportateur_nom", "exportateur"], "exportateur_nom": ["exportateur_nom", "exportateur"], "importateur": ["importateur_nom", "importateur"], "importateur_nom": ["importateur_nom", "importateur"]}
ALSO |= {name: ["declarant_nom", "declarant", "nom_declarant"] for name in ("declarant", "declarant_nom", "nom_declarant")} | {"pays_destination_finale": ["pays_destination_finale", "pays_destination"]}


def exporter_name(value: Column) -> Column:
    """A name of eight letters or more without what stands behind it on the form, of 120 characters at most, cut between words."""
    return exporter_in_folded(fold_text(value))


def exporter_in_folded(t: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(t, r"\bDATE\b\s*[A-Z0-9]{0,4}", " "), r"\b(?:NUMERO|CERTIFICAT|DECLARATION|CODE)\b.*$", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ \-|]+|[ \-|]+$", "")
    t = F.when(F.length(t) > 120, F.trim(F.regexp_replace(F.substring(t, 1, 120), r" [^ ]*$", ""))).otherwise(t)
    return F.when(F.length(F.regexp_replace(t, "[^A-Z]", "")) >= 8, t)


def zone_value(key: Column, text: Column, t: Column) -> Column:
    """The value of a cell by the family of its field; t is its folded text. Null where the cell doesn't hold such a value."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    importer = (F.size(F.regexp_extract_all(t, F.lit("[A-Z]{2,}"), F.lit(0))) > 2) & ~t.rlike(POLLUTED)
    typed = (
        F.when(key.isin("exportateur", "exportateur_nom"), exporter_in_folded(t)).when(key.isin("importateur", "importateur_nom"), F.when(importer, text)).when(key.isin("declarant", "declarant_nom", "nom_declarant"), F.when(letters >= 3, text)).when(key.isin(PLACES), country_in_folded(t))
        .when(key == "numero_declaration", found(text, r"\b(\d{6})\b")).when(key == "date_declaration", normalize_date(found(text, rf"\b({DAY})\b"))).when(key == "type_declaration", found(t, KINDS_OF_DECLARATION))
    )
    for name, high in COUNTS.items():
        typed = typed.when(key == name, cell_number(text, 1, high))
    return (
        typed.when(key.isin(BUREAUS), cell_number(text, 1, 999, boxes=False, last=False)).when(key.isin(BOXED), cell_number(text, 1, 99_999)).when(key.isin("qualite_fiscale", *NUMBERS), cell_number(text, 1, 99_999, boxes=False)).when(key.isin(AMOUNTS), clean_amount(found(text, r"\b(\d{1,12}[,.]\d{3,8})\b")))
        .when(key == "bureau_douane", F.concat(F.lit("BR - "), F.upper(found(text, r"(?i)\bBR\s*-\s*(ARIANA|TUNIS|SFAX|BIZERTE)\b")))).when(key == "itineraire", route(t)).otherwise(text)
    )


def zone_names(key: Column) -> Column:
    """All names under which a cell's value is kept, an array."""
    names = F.lit(None).cast("array<string>")
    for name, also in ALSO.items():
        names = F.when(key == name, F.array(*map(F.lit, also))).otherwise(names)
    return F.coalesce(names, F.array(key))


def zone_fields(zones: DataFrame) -> DataFrame:
    """(id, field_key, value) of zones (id, zones map): cells tpl_* by the family of their field, each under all names of the field, of
    several the least; blank and wrong ones, and blocks, are left out. Cells stay in their row until they are told; only rows that
    repeat an id meet."""
    pair = lambda z: F.transform(z["names"], lambda n: F.struct(n.alias("field_key"), z["value"].alias("value")))
    told = zones.select("id", zones_within(F.col("zones")).alias("told")).select("id", F.flatten(F.transform("told", pair)).alias("told"))
    told = told.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("told"))).alias("told"))
    first = F.filter("told", lambda z, i: (i == 0) | (F.get("told", i - 1)["field_key"] != z["field_key"]))
    return told.select("id", F.explode_outer(first).alias("z")).where("z is not null").select("id", "z.*")


def zones_within(zones: Column) -> Column:
    """The same values within the row of a map of cells, without a shuffle: an array of (names, value)."""
    own = F.filter(F.map_entries(zones), lambda e: e["key"].startswith("tpl_") & ~e["key"].startswith("tpl_block_"))
    cells = F.transform(own, lambda e: F.struct(F.substring(e["key"], 5, 99).alias("field"), filled(F.regexp_replace(e["value"], r"\s+", " ")).alias("text")))
    folded = F.transform(F.filter(cells, lambda c: c["text"].isNotNull()), lambda c: F.struct(c["field"].alias("field"), c["text"].alias("text"), fold_text(c["text"]).alias("folded")))
    told = F.transform(folded, lambda c: F.struct(zone_names(c["field"]).alias("names"), zone_value(c["field"], c["text"], c["folded"]).alias("value")))
    return F.filter(told, lambda c: c["value"].isNotNull())


def zone_of(zones: Column, name: str) -> Column:
    """The value of a field among zones_within, the least of several; null without one."""
    return F.array_min(F.transform(F.filter(zones, lambda z: F.array_contains(z["names"], name)), lambda z: z["value"]))


# Fields that take another's value where they are empty, in order, and words for no value.
ALIASES = [
    ("exportateur", "exportateur_nom"), ("importateur", "importateur_nom"), ("declarant", "declarant_nom"), ("nombre_articles", "nbre_articles"), ("valeur_fob_dt", "valeur_fob"), ("valeur_dinars", "douane"), ("valeur_dinars", "valeur_fob_dt"), ("valeur_dinars", "valeur_fob"), ("qcs", "code_qcs"),
    ("description_marchandise", "designation_marchandises"),
]
EMPTY = ["", "null", "none", "n/a", "-"]
NO_PLACE, PLACED = ["0", "00", "000", "45", "46", "47", "48", "49", "50", "56"], ["bureau_frontiere", "destination", "code_regime_financier", "code_delai"]
DECIMALS = ["poids_brut", "poids_net", "montant_liquidation", "valeur_fob_dt", "taux_conversion"]


def real(c: Column) -> Column:
    """A value without blanks around it, null for the words for none."""
    return F.when(~F.lower(F.trim(c)).isin(EMPTY), F.trim(c))


def fill_aliases(rows: DataFrame) -> DataFrame:
    """rows (wide, some of the fields) with empty fields filled from their other names, one after the other; fields that aren't there are
    passed over. A known misreading of a route is put right, placeholders of places and codes go, decimals get a point."""
    have = set(rows.columns)
    rows = rows.withColumns({c: real(F.col(c)) for c in {x for pair in ALIASES for x in pair} & have})
    for to, source in ALIASES:
        if {to, source} <= have:
            rows = rows.withColumn(to, F.coalesce(to, source))
    plain = lambda c: F.replace(F.trim(c), F.lit(" "), F.lit(""))
    rows = rows.withColumns({c: F.when(~F.trim(c).isin(NO_PLACE), F.col(c)) for c in PLACED if c in have} | {c: F.when(plain(c).rlike(r"^\d+[.,]\d+$"), F.replace(plain(c), F.lit(","), F.lit("."))).otherwise(F.col(c)) for c in DECIMALS if c in have})
    if "itineraire" in have:
        rows = rows.withColumn("itineraire", F.when(F.upper(F.trim("itineraire")) == "FAX-RADES", "SFAX-RADES").otherwise(F.col("itineraire")))
    if "relation_acheteur_vendeur" in have:
        rows = rows.withColumn("relation_acheteur_vendeur", F.when(~F.trim("relation_acheteur_vendeur").isin("0", "08"), F.col("relation_acheteur_vendeur")))
    return rows


# How documents are called.
CALLED = {"dum": ("N° déclaration", "Date déclaration", "DUM"), "invoice": ("N° facture", "Date facture", "Facture")}


def document_line(kind: str, number: Column, date: Column, fallback: Column) -> Column:
    """`N° .. · Date ..`, with what there is of both; without both the kind and the id."""
    n, d = filled(number.cast("string")), filled(date.cast("string"))
    by_number, by_date, name = CALLED[kind]
    line = F.concat_ws(" · ", F.concat(F.lit(f"{by_number} "), n), F.concat(F.lit(f"{by_date} "), d))
    return F.when(n.isNotNull() | d.isNotNull(), line).otherwise(F.concat(F.lit(f"{name} #"), fallback.cast("string")))


def pair_line(dum: Column, invoice: Column) -> Column:
    return F.concat_ws(" · ", dum, invoice)


def compact_parts(number: Column, date: Column, fallback: Column, prefix: str = "Doc") -> Column:
    """struct(number, date) for lists: the number, else the prefix and the id, else a dash."""
    other = F.coalesce(F.concat(F.lit(f"{prefix} #"), fallback.cast("string")), F.lit("—"))
    return F.struct(F.coalesce(filled(number.cast("string")), other).alias("number"), filled(date.cast("string")).alias("date"))


# Kinds and names of files that are taken in.
CONTENT, FILES = ["image/png", "image/jpeg", "image/jpg", "image/tiff", "application/pdf"], r"\.(png|jpe?g|tiff?|pdf)$"


def rejected_content(kind: Column, name: Column) -> Column:
    """Why a file isn't taken in: null where its kind or its name says that it is an image or a PDF."""
    allowed = F.coalesce(kind.isin(CONTENT), F.lit(False)) | F.coalesce(F.lower(name).rlike(FILES), F.lit(False))
    return F.when(~allowed, "content_type_not_allowed")


def json_rows(raw: Column, fields: str) -> Column:
    """The rows of a JSON array column, e.g. json_rows(c, "code: string"); none where it is null or broken; null rows go."""
    kind = f"array<struct<{fields}>>"
    return F.coalesce(F.filter(F.from_json(raw, kind, {"mode": "PERMISSIVE"}), lambda x: x.isNotNull()), F.array().cast(kind))


def union_flags(*flags: Column) -> Column:
    """All flags of several arrays once, in order; null counts as none."""
    out = F.array().cast("array<string>")
    for f in flags:
        out = F.array_union(out, F.coalesce(f, F.array().cast("array<string>")))
    return F.array_sort(out)
